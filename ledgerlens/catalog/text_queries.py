"""Registered queries: text, date, dictionary and vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog.registry import query
from ledgerlens.functions import text as X
from ledgerlens.operators import resolve as R
from ledgerlens.operators.aggregates import mode_by_count
from ledgerlens.tables import Tables

WORDS = {"la": "the", "un": "one"}
ALIASES = {"et": "and"}


def _normal_sql(c: str) -> str:
    out = f"trim(regexp_replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '[?.!]+$', ''))"
    for w, by in {**WORDS, **ALIASES}.items():
        once = "regexp_replace({x}, '(^|[^\\p{L}\\p{N}_])" + w + "($|[^\\p{L}\\p{N}_])', '\\1" + by + "\\2', 'g')"
        out = once.replace("{x}", once.replace("{x}", out))
    return out


@query("n01_normalise_text", f"""
SELECT 'documents' AS source, doc_id AS id, md5({_normal_sql('text')}) AS text_hash FROM documents
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, md5({_normal_sql('text')}) FROM conversations""")
def n01(t: Tables) -> DataFrame:
    normal = F.md5(X.normalise_query_text("text", WORDS, ALIASES)).alias("text_hash")
    return t.documents.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), normal).unionByName(
        t.conversations.select(F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), normal))


@query("n02_collapsed_key", """
SELECT md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key_hash, count(*) AS copies FROM documents GROUP BY 1""")
def n02(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5(X.collapsed_key("text")).alias("key_hash")).agg(F.count("*").alias("copies"))


def _asked(t: Tables) -> DataFrame:
    """Part names as typed, cut by a letter, aliased and foreign, by part number."""
    kind = F.col("p_partkey") % 4
    return t.part.select(
        F.when(kind == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
        .when(kind == 1, F.expr("substring(p_name, 1, length(p_name) - 1)"))
        .when(kind == 2, F.concat(F.lit("the "), "p_name")).otherwise("zzqx unknown thing").alias("typed"))


@query("n03_dictionary_resolution", """
WITH d AS (SELECT DISTINCT p_name AS v FROM part),
 a AS (SELECT DISTINCT lower(trim(CASE p_partkey % 4 WHEN 0 THEN '  ' || upper(p_name) || ' ' WHEN 1 THEN left(p_name, length(p_name) - 1)
   WHEN 2 THEN 'the ' || p_name ELSE 'zzqx unknown thing' END)) AS asked FROM part),
 ex AS (SELECT asked, v, 'exact' AS confidence, 100.0::DOUBLE AS score FROM a JOIN d ON asked = lower(v)),
 al AS (SELECT asked, v, 'alias' AS confidence, 100.0::DOUBLE AS score FROM a JOIN d ON asked = 'the ' || lower(v) WHERE asked NOT IN (SELECT asked FROM ex)),
 rest AS (SELECT asked FROM a WHERE asked NOT IN (SELECT asked FROM ex) AND asked NOT IN (SELECT asked FROM al)),
 fz AS (SELECT asked, v, (1 - levenshtein(asked, lower(v)) / greatest(length(asked), length(v))) * 100 AS score FROM rest, d),
 best AS (SELECT asked, v, score FROM fz WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, v) = 1)
SELECT * FROM ex UNION ALL SELECT * FROM al UNION ALL SELECT asked, v, 'fuzzy', round(score, 6) FROM best
UNION ALL SELECT asked, NULL, 'none', NULL FROM rest WHERE asked NOT IN (SELECT asked FROM best)""".replace("asked, v,", "asked, v AS value,", 1))
def n03(t: Tables) -> DataFrame:
    names = t.part.select("p_name").distinct()
    aliases = names.select(F.concat(F.lit("the "), "p_name").alias("alias"), F.col("p_name").alias("canonical"))
    return R.resolve(_asked(t), "typed", t.part, "p_name", aliases).withColumn("score", F.round("score", 6))


@query("n03_suggestions", """
WITH d AS (SELECT DISTINCT p_name AS v FROM part),
 a AS (SELECT DISTINCT p_type || ' goods' AS t FROM part UNION SELECT DISTINCT 'zz ' || left(p_name, length(p_name) - 2) FROM part WHERE p_size > 45)
SELECT lower(t) AS asked, v AS suggestion, round((1 - levenshtein(lower(t), v) / greatest(length(t), length(v))) * 100, 6) AS score,
  CAST(row_number() OVER (PARTITION BY lower(t) ORDER BY levenshtein(lower(t), v) / greatest(length(t), length(v)), v) AS INTEGER) AS position
FROM a, d QUALIFY position <= 3""")
def n03_suggest(t: Tables) -> DataFrame:
    # two words that resemble no name, and names with letters too many and too few
    missing = t.part.select(X.collapsed_key(F.concat("p_type", F.lit(" goods"))).alias("asked")).union(t.part.filter("p_size > 45").select(
        X.collapsed_key(F.concat(F.lit("zz "), F.expr("substring(p_name, 1, length(p_name) - 2)"))).alias("asked")))
    return R.suggestions(missing, t.part, "p_name").withColumn("score", F.round("score", 6))


@query("n04_roster_resolution", """
WITH p AS (SELECT p_partkey, lower(p_name) AS nm, lower(p_brand) AS pl FROM part), names AS (SELECT DISTINCT nm FROM p),
 t AS (SELECT nm AS asked FROM p UNION SELECT nm || ' of ' || pl FROM p UNION SELECT CAST(p_partkey AS VARCHAR) FROM p
   UNION SELECT 'the ' || nm FROM p UNION SELECT left(nm, length(nm) - 1) || 'xq' FROM p),
 coded AS (SELECT asked FROM t JOIN p ON asked = CAST(p_partkey AS VARCHAR)),
 exact AS (SELECT asked, asked AS want, NULL AS pl FROM t WHERE asked IN (SELECT nm FROM names)),
 named AS (SELECT asked, substr(asked, 5) AS want, NULL AS pl FROM t WHERE asked LIKE 'the %' AND substr(asked, 5) IN (SELECT nm FROM names)
   AND asked NOT IN (SELECT asked FROM exact)),
 placed AS (SELECT asked, split_part(asked, ' of ', 1) AS want, substr(asked, length(split_part(asked, ' of ', 1)) + 5) AS pl FROM t
   WHERE asked LIKE '% of %' AND split_part(asked, ' of ', 1) IN (SELECT nm FROM names)
   AND asked NOT IN (SELECT asked FROM exact UNION SELECT asked FROM named)),
 rest AS (SELECT asked FROM t WHERE asked NOT IN (SELECT asked FROM coded UNION SELECT asked FROM exact UNION SELECT asked FROM named UNION SELECT asked FROM placed)),
 close AS (SELECT asked, nm AS want, NULL AS pl FROM rest, names WHERE (1 - levenshtein(asked, nm) / greatest(length(asked), length(nm))) * 100 >= 85),
 want AS (SELECT * FROM exact UNION ALL SELECT * FROM named UNION ALL SELECT * FROM placed UNION ALL SELECT * FROM close),
 h AS (SELECT asked, p_partkey, count(*) OVER (PARTITION BY asked) AS n, row_number() OVER (PARTITION BY asked ORDER BY p_partkey) AS rn
   FROM want w JOIN p ON p.nm = w.want AND (w.pl IS NULL OR w.pl = p.pl)),
 f AS (SELECT asked, any_value(n) AS matches, CASE WHEN any_value(n) = 1 THEN max(CAST(p_partkey AS VARCHAR)) END AS bound,
  CASE WHEN any_value(n) > 1 THEN string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (rn <= 12) END AS candidates FROM h GROUP BY asked)
SELECT asked, coalesce(matches, 0) AS matches, bound, candidates FROM t LEFT JOIN f USING (asked) WHERE asked NOT IN (SELECT asked FROM coded)
UNION ALL SELECT asked, 1, asked, NULL FROM coded""")
def n04(t: Tables) -> DataFrame:
    def asked(text) -> DataFrame:
        return t.part.select(text.alias("q"))

    texts = (
        asked(F.col("p_name")).unionByName(asked(F.concat("p_name", F.lit(" of "), "p_brand"))).unionByName(asked(F.col("p_partkey").cast("string")))
        .unionByName(asked(F.concat(F.lit("The "), "p_name")))  # aliases
        .unionByName(asked(F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit("xq")))))  # misspelt
    aliases = t.part.select(F.concat(F.lit("the "), "p_name").alias("alias"), F.col("p_name").alias("canonical")).distinct()
    return R.resolve_roster(texts, "q", t.part, "p_partkey", "p_name", "p_brand", listed=12, aliases=aliases)


@query("n05_amount_parsing", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN round(p_size * 1e5, 2) WHEN 1 THEN round(p_retailprice, 2) WHEN 2 THEN round((p_size + 0.5) * 1e7, 2)
  WHEN 3 THEN NULL ELSE round(p_size * 1e3, 2) END AS rupees, CASE p_partkey % 5 WHEN 0 THEN 'lakh' WHEN 2 THEN 'cr' WHEN 4 THEN 'k' END AS unit,
  CASE WHEN p_partkey % 5 = 3 THEN 'unknown amount unit' END AS error FROM part""")
def n05(t: Tables) -> DataFrame:
    kind, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = (
        F.when(kind == 0, F.concat(size, F.lit(" lakh rupees"))).when(kind == 1, F.concat(F.lit("₹"), F.format_number("p_retailprice", 2), F.lit("/-")))
        .when(kind == 2, F.concat(F.lit("Rs. "), size, F.lit(".5 Cr."))).when(kind == 3, F.concat(size, F.lit(" bighas"))).otherwise(F.concat(size, F.lit("k"))))
    return t.part.select("p_partkey", X.parse_amount(raw).alias("a")).select("p_partkey", "a.rupees", "a.unit", "a.error")


@query("n06_fiscal_year_extraction", """
WITH y AS (SELECT o_orderkey, o_orderkey % 10 AS k, year(o_orderdate) + 20 AS y FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 2, 3, 8) THEN y || '-' || (y + 1) WHEN k = 4 THEN y || '-' || (y + 1) || ',' || (y + 2) || '-' || (y + 3)
  WHEN k IN (5, 6, 9) THEN '' ELSE (y - 1) || '-' || y || ',' || y || '-' || (y + 1) END AS years FROM y""")
def n06(t: Tables) -> DataFrame:
    k, y = F.col("o_orderkey") % 10, F.year("o_orderdate") + 20
    s = y.cast("string")
    nxt = F.lpad(((y + 1) % 100).cast("string"), 2, "0")
    two = F.lpad((y % 100).cast("string"), 2, "0")
    text = (
        F.when(k == 0, F.concat(F.lit("plan for FY "), s, F.lit("-"), (y + 1).cast("string")))
        .when(k == 1, F.concat(F.lit("spent in "), s, F.lit("-"), nxt)).when(k == 2, F.concat(F.lit("cost, F.Y. "), two, F.lit("/"), nxt, F.lit(" only")))
        .when(k == 3, F.concat(F.lit("in "), F.translate(s, "0123456789", X.NATIVE_DIGITS)))
        .when(k == 4, F.concat(F.lit("between "), s, F.lit("-"), (y + 2).cast("string")))
        .when(k == 5, F.concat(F.lit("more than ₹"), s, F.lit(" paid"))).when(k == 6, F.concat(s, F.lit(" households")))
        .when(k == 8, F.concat(s, F.lit("-"), (y + 2).cast("string"), F.lit("   households")))
        .when(k == 9, F.concat(F.lit("Rs"), F.lit(" " * 12), s, F.lit(" paid")))
        .otherwise(F.concat(s, F.lit("-"), nxt, F.lit(" vs "), (y - 1).cast("string"), F.lit("-"), two)))
    return t.orders.select("o_orderkey", F.concat_ws(",", X.absolute_fiscal_years(text)).alias("years"))


@query("n07_relative_years", """
WITH k AS (SELECT list(l ORDER BY l) AS known FROM (SELECT DISTINCT year(o_orderdate) || '-' || (year(o_orderdate) + 1) AS l FROM orders))
SELECT o_orderkey, array_to_string(CASE o_orderkey % 4 WHEN 0 THEN known[-1:] WHEN 1 THEN known[-2:-2] WHEN 2 THEN known[-3:] ELSE [] END, ',') AS years FROM orders, k""")
def n07(t: Tables) -> DataFrame:
    known = t.orders.select(X.year_label(F.year("o_orderdate")).alias("y")).distinct().agg(F.array_sort(F.collect_list("y")).alias("known"))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "spending this year").when(k == 1, "How much in the previous financial year?").when(
        k == 2, "trend over the last three years").otherwise("all orders")
    # a row with the few years there are
    return t.orders.crossJoin(F.broadcast(known)).select("o_orderkey", F.concat_ws(",", X.fiscal_years(text, F.col("known"))).alias("years"))


@query("n08_date_windows", """
WITH y AS (SELECT o_orderkey, o_orderkey % 4 AS k, year(o_orderdate) + 20 AS y, month(o_orderdate) AS m FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN y || '-04-01' WHEN 1 THEN strftime(make_date(y, m, 1), '%Y-%m-%d') WHEN 2 THEN y || '-01-01' END AS first_day,
  CASE k WHEN 0 THEN (y + 1) || '-03-31' WHEN 1 THEN strftime(last_day(make_date(y, m, 1)), '%Y-%m-%d') WHEN 2 THEN (y + 2) || '-12-31' END AS last_day FROM y""")
def n08(t: Tables) -> DataFrame:
    k, y = F.col("o_orderkey") % 4, F.year("o_orderdate") + 20
    s = y.cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("approved in FY "), s, F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0")))
        .when(k == 1, F.concat(F.lit("in "), F.date_format("o_orderdate", "MMMM"), F.lit(", "), s))
        .when(k == 2, F.concat(F.lit("between "), s, F.lit(" and "), (y + 2).cast("string"))).otherwise("ever"))
    w = t.orders.select("o_orderkey", X.date_window(text).alias("w"))
    return w.select("o_orderkey", F.date_format("w.start", "yyyy-MM-dd").alias("first_day"), F.date_format("w.end", "yyyy-MM-dd").alias("last_day"))


@query("n09_deadline_parsing", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 OR (o_orderkey % 5 = 3 AND day(o_orderdate) <= 12) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline,
  CASE WHEN o_orderkey % 5 = 4 THEN 'not a date' WHEN o_orderkey % 5 = 3 AND day(o_orderdate) <= 12 THEN 'ambiguous' END AS error FROM orders""")
def n09(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "d MMMM yyyy"))
        .when(k == 2, F.date_format("o_orderdate", "MMM dd, yyyy")).when(k == 3, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("soon"))
    return t.orders.select("o_orderkey", X.parse_deadline(text).alias("d")).select(
        "o_orderkey", F.date_format("d.deadline", "yyyy-MM-dd").alias("deadline"), "d.error")


@query("n10_slot_vocabulary", "SELECT p_brand AS value, count(*) AS uses FROM part GROUP BY p_brand")
def n10(t: Tables) -> DataFrame:
    return R.vocabulary(t.part, "p_brand")


def _queries(t: Tables) -> DataFrame:
    """One query vector per owner: its first vector."""
    return t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(
        F.concat(F.lit("q"), F.col("label").cast("string")).alias("query"), "vector")


_VEC = """q AS (SELECT 'q' || label AS query, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
 s AS (SELECT query, CAST(label AS VARCHAR) AS owner, max(list_cosine_similarity(v, embedding::DOUBLE[])) AS score, count(*) AS vectors FROM q, embeddings GROUP BY 1, 2),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, owner) AS INTEGER) AS position FROM s)"""


def _top(t: Tables, k: int) -> DataFrame:
    return R.vector_top_k(t.embeddings, "label", "embedding", _queries(t), k)


@query("n11_vector_top_k", f"WITH {_VEC} SELECT query, owner, round(score, 5) AS score, position, vectors FROM k WHERE position <= 3")
def n11(t: Tables) -> DataFrame:
    return _top(t, 3).withColumn("score", F.round("score", 5))


_ZONED = """q AS (SELECT f.query || s.sign AS query, list_transform(f.v, lambda x: x * s.w) AS v FROM (
   SELECT 'q' || label AS query, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label) f,
   (VALUES ('+', 1.0), ('-', -1.0)) s(sign, w)),
 k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, owner) AS position FROM (
   SELECT query, label AS owner, max(list_cosine_similarity(v, embedding::DOUBLE[])) AS score FROM q, embeddings GROUP BY 1, 2))"""


@query("n12_confidence_zone", f"""WITH {_ZONED}, f AS (SELECT query, max(score) FILTER (position = 1) AS first, max(score) FILTER (position = 2) AS second FROM k GROUP BY query)
SELECT query, CASE WHEN first < 0.30 THEN 'no_match' WHEN first < 0.50 AND first - second < 0.015 THEN 'ambiguous' ELSE 'proceed' END AS zone FROM f""")
def n12(t: Tables) -> DataFrame:
    """Zones of each owner's first vector and of the vector that points the other way, which resembles little."""
    first = _queries(t).withColumn("vector", F.col("vector").cast("array<double>"))
    away = first.select(F.concat("query", F.lit("-")).alias("query"), F.transform("vector", lambda x: -x).alias("vector"))
    both = first.select(F.concat("query", F.lit("+")).alias("query"), "vector").unionByName(away)
    return R.confidence_zone(R.vector_top_k(t.embeddings, "label", "embedding", both, 2)).select("query", "zone")


@query("n13_recall_at_k", f"""WITH {_VEC}, g AS (SELECT query, CAST((CAST(substr(query, 2) AS INTEGER) + 1) % 10 AS VARCHAR) AS gold FROM q),
 h AS (SELECT g.query, position FROM g LEFT JOIN k ON k.query = g.query AND k.owner = gold)
SELECT CAST(x AS INTEGER) AS k, (SELECT count(*) FROM h) AS queries, (SELECT round(avg(CASE WHEN position <= x THEN 1.0 ELSE 0.0 END), 6) FROM h) AS recall
FROM (SELECT unnest([1, 3, 5, 10]) AS x)""")
def n13(t: Tables) -> DataFrame:
    gold = _queries(t).select("query", ((F.substring("query", 2, 9).cast("int") + 1) % 10).cast("string").alias("gold"))
    return R.recall_at(_top(t, 10), gold, [1, 3, 5, 10]).withColumn("recall", F.round("recall", 6))


@query("n14_consistency_table", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, CAST(sum(n) FILTER (lang = 'en') AS DOUBLE) AS en, CAST(sum(n) FILTER (lang = 'fr') AS DOUBLE) AS fr, CAST(sum(n) FILTER (lang = 'de') AS DOUBLE) AS de,
  arg_min(lang, (-n, lang)) AS modal, round(max(n) / sum(n), 6) AS share FROM c GROUP BY source""")
def n14(t: Tables) -> DataFrame:
    table = t.documents.groupBy("source").pivot("lang", ["en", "fr", "de"]).count()
    modal = mode_by_count(t.documents, ["source"], "lang", "modal")
    share = t.documents.groupBy("source", "lang").count().groupBy("source").agg((F.max("count") / F.sum("count")).alias("share"))
    return table.join(modal, "source").join(share, "source").select(
        "source", *[F.col(c).cast("double").alias(c) for c in ("en", "fr", "de")], "modal", F.round("share", 6).alias("share"))


@query("n15_grading_buckets", """
SELECT lang, CASE WHEN quality IS NULL THEN 'new' WHEN toxic = 1 AND quality = 1 THEN 'wrong_direction' WHEN toxic = 1 THEN 'refusal'
  WHEN quality = 1 THEN CASE WHEN n_chars < 200 THEN 'partial' ELSE 'hit' END ELSE 'fallback' END AS verdict, count(*) AS records
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def n15(t: Tables) -> DataFrame:
    q, x = F.col("quality"), F.col("toxic")
    verdict = (
        F.when(q.isNull(), "new").when((x == 1) & (q == 1), "wrong_direction").when(x == 1, "refusal")
        .when(q == 1, F.when(F.col("n_chars") < 200, "partial").otherwise("hit")).otherwise("fallback"))
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left").groupBy("lang", verdict.alias("verdict")).agg(
        F.count("*").alias("records"))


@query("n16_usage_rollup", """
SELECT role AS site, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS tokens, median(length(text))::DOUBLE AS median_tokens,
  round(avg(length(text)), 6) AS mean_tokens, round(avg(CASE WHEN turn = 0 THEN 1 ELSE 0 END), 4) AS first_turn_rate FROM conversations GROUP BY role""")
def n16(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.conversations.groupBy(F.col("role").alias("site")).agg(
        F.count("*").alias("calls"), F.sum(n).alias("tokens"), F.median(n).alias("median_tokens"), F.round(F.avg(n), 6).alias("mean_tokens"),
        F.round(F.avg((F.col("turn") == 0).cast("int")), 4).alias("first_turn_rate"))
