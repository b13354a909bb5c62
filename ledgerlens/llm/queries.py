"""Registered queries of this package and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    centroids, covertree, decontaminate, language, packing, pagecut, pii, quality_rules, repair, sharding, simhash, substring, toxicity,
)

LLM_QUERIES = {}
LLM_SQL = {}


def query(run):
    LLM_QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


@query
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, folder, "documents")))


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle_words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fold(spark_id: str, parts: int):
    """The remainder by which rows are held out: crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(spark_id).cast("string").cast("binary")), F.lit(parts))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, learn=fold("doc_id", 5) != 0)


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, folder, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, folder, "embeddings"), threshold=0.98)


LLM_SQL["op7_embedding_dedup"] = """
WITH RECURSIVE v AS MATERIALIZED (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), link AS MATERIALIZED (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE isfinite(list_cosine_similarity(a.e, b.e)) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(x, y) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.x = v.vec_id) AS n_links,
       (SELECT min(r.y) FROM reach r WHERE r.x = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(r.y) FROM reach r WHERE r.x = v.vec_id) AS kept
FROM v
"""


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    found = language.predict(docs, language.fit(docs, learn=~held_out & F.col("doc_id").isNotNull()))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


@query
def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = pagecut.extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.report(repair.repair(repair.damaged(table(spark, folder, "conversations"))))


def _repair_sql() -> str:
    """A table of best paths by role state, one row for each turn; a path is its cost in six digits and its letters."""
    def add(path: str, cost: str, letters: str) -> str:
        return f"CASE WHEN {path} IS NOT NULL THEN printf('%06d', substr({path}, 1, 6)::INT + {cost}) || substr({path}, 7) || '{letters}' END"

    before = {0: ["d.s0"], 1: ["d.s1"],
              2: ["d.s2", add("d.s2", "4", "II"), *[add(f"d.s{k}", "2", "I") for k in (0, 1, 3)]],
              3: ["d.s3", add("d.s2", "2", "I"), *[add(f"d.s{k}", "4", "II") for k in (0, 1, 3)]]}

    def step(state: int) -> str:
        options = [add(f"({p})", "3", "D") for p in before[state]]
        came = {1: [0], 2: [0, 1, 3], 3: [2]}.get(state, [])
        role = " sua"[state]
        for p in (p for k in came for p in before[k]):
            options.append(f"CASE WHEN NOT gone AND initial = '{role}' THEN {add(f'({p})', 'cut', 'K')} END")
            if role != "s":
                options.append(f"CASE WHEN NOT gone THEN {add(f'({p})', '2 + cut', 'R')} END")
        return f"least({', '.join(options)})"

    return f"""
WITH RECURSIVE bits(i, k, c) AS (
    SELECT i, 0, i FROM range(256) AS r(i)
    UNION ALL SELECT i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8), base AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), coded AS (
    SELECT base.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM base, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM coded, range(2) AS r(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged
), faulty AS (
    SELECT *, CASE WHEN said = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
                   WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || left(role, 1) AS pair FROM placed
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), turns AS MATERIALIZED (
    SELECT conv_id, rn, role, text, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INT AS cut FROM faulty
), dp AS (
    SELECT conv_id, n, 0::BIGINT AS rn, '000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM facts
    UNION ALL SELECT d.conv_id, d.n, t.rn, {step(0)}, {step(1)}, {step(2)}, {step(3)}
    FROM dp d JOIN turns t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.rn = d.rn + 1
), best AS MATERIALIZED (
    SELECT conv_id, least(s0, {add('s1', '4', 'II')}, {add('s2', '2', 'I')}, s3) AS path FROM dp WHERE rn = n
), walk AS (
    SELECT conv_id, path, 7 AS k, 0::BIGINT AS rn, '' AS last, []::VARCHAR[] AS lines FROM best
    UNION ALL SELECT w.conv_id, path, k + 1, w.rn + (substr(path, k, 1) <> 'I')::INT,
        CASE WHEN substr(path, k, 1) = 'D' THEN last WHEN substr(path, k, 1) = 'K' THEN initial WHEN last = 'u' THEN 'a' ELSE 'u' END,
        CASE WHEN substr(path, k, 1) = 'D' THEN lines
             WHEN substr(path, k, 1) = 'K' THEN list_append(lines, role || ':' || text)
             ELSE list_append(lines, CASE WHEN last = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN substr(path, k, 1) = 'R' THEN text ELSE '' END) END
    FROM walk w LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.rn = w.rn + 1 WHERE k <= length(path)
), repaired AS (
    SELECT conv_id, substr(path, 1, 6)::BIGINT AS cost, substr(path, 7) AS audit,
           sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM walk WHERE k = length(path) + 1
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""


LLM_SQL["op11_turn_repair"] = _repair_sql()


@query
def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    rules = quality_rules.learn(docs, table(spark, folder, "labels"), learn_from=~held_out)
    judged = quality_rules.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", "judged.*", held_out.alias("held_out"))


@query
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.report(*centroids.cluster(table(spark, folder, "embeddings"), clusters=16, rounds=3, components=64))


def _lloyd_sql(clusters: int, rounds: int) -> str:
    """Each round is a join of vector and centroid components; sums of integers, so no order of addition matters."""
    steps = [f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS MATERIALIZED (
    SELECT vec_id, j, floor(64 * e[j])::BIGINT AS x FROM kept, range(1, 65) AS r(j)
), first AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept
), cent0 AS MATERIALIZED (
    SELECT c, j, x AS v FROM first JOIN comp USING (vec_id) WHERE c < {clusters}
)"""]
    for k in range(rounds + 1):
        steps.append(f""", near{k} AS MATERIALIZED (
    SELECT vec_id, min(d) AS distance, arg_min(c, (d, c)) AS c
    FROM (SELECT vec_id, c, sum((x - v) * (x - v))::BIGINT AS d FROM comp JOIN cent{k} USING (j) GROUP BY ALL) GROUP BY vec_id
)""")
        if k < rounds:
            steps.append(f""", mean{k} AS (
    SELECT c, j, sum(x) AS s, count(*) AS n FROM comp JOIN near{k} USING (vec_id) GROUP BY ALL
), cent{k + 1} AS MATERIALIZED (
    SELECT c, j, coalesce((s - ((s % n) + n) % n) // n, v)::BIGINT AS v FROM cent{k} LEFT JOIN mean{k} USING (c, j)
)""")
    return "".join(steps) + f"""
SELECT n.vec_id, n.c::INT AS cluster, n.distance, (sum(n.distance) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
       (sum(n.distance) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM near{rounds} n JOIN (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM cent{rounds} GROUP BY c) h USING (c)
"""


LLM_SQL["op13_centroids"] = _lloyd_sql(16, 3)
