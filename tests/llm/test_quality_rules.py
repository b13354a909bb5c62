"""Statistics against plain Python, learned rules on held-out rows, and the defined cases."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a b", "a a a", "a a a a", "é x 😀 😀", "x\ny\nx\n\n \nx", "#*$%&|<> -", "a\x0bb\x0cc\rd"]
    texts += ["".join(rng.choice(["a", "bb", "c", " ", " ", "\n", "#", "\t"]) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += [" ".join(rng.choice("ab") for _ in range(5000)), " ".join(map(str, range(20_000)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["judged"] for r in q.judge(frame, q.RuleList()).collect()}
    for k, text in enumerate(texts):
        want = plain(text)
        assert tuple(found[k][c] for c in BASE) == want, text
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (found[k]["base_failed"], found[k]["kept"], found[k]["rule"]) == (failed, not failed, 0)


def test_windows_that_share_a_hash(spark):
    """With places in nearly all bits of a window's number, different windows meet and are told apart by their words."""
    words = [f"w{k % 41}" for k in range(300)] + [f"x{k}" for k in range(300)]
    frame = spark.createDataFrame([(words,)], "words array<string>")
    found = [frame.select(q._repeated_words(F.col("words"), F.lit(bits)).alias("n")).first()["n"] for bits in (10, 52, 60, 63)]
    assert found == [300] * 4


def corpus(spark, rows, seed):
    """Texts of which those with many symbols, or long words and few marks, are bad."""
    rng = random.Random(seed)
    out = []
    for k in range(rows):
        kind = rng.choice(["good", "good", "symbols", "long"])
        size = 12 if kind == "long" else 4
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(size - 2, size + 2))) for _ in range(90)]
        if kind == "symbols":
            words = [w + rng.choice(["#", "%", ""]) for w in words]
        if kind != "long" or rng.random() < 0.3:
            words = [w + ("." if rng.random() < 0.2 else "") for w in words]
            kind = "good" if kind == "long" else kind
        out.append((k, " ".join(words), int(kind == "good")))
    return spark.createDataFrame(out, "doc_id long, text string, quality int")


def test_rules_hold_on_rows_not_learned_from(spark):
    docs = corpus(spark, 1500, 5)
    labels = docs.select("doc_id", "quality").where("doc_id % 3 <> 0")
    rules = q.learn(docs.drop("quality"), labels, learn_from=F.lit(True))
    assert 2 <= len(rules.rules) <= 12 and all(rule for rule in rules.rules)
    assert re.fullmatch(r"(\d+\. reject if \w+ (>=|<) [\d.e+-]+( and \w+ (>=|<) [\d.e+-]+)*\n?)+", str(rules))
    held_out = q.judge(docs.where("doc_id % 3 = 0"), rules).select("quality", "judged.kept").collect()
    right = sum(bool(r["quality"]) == r["kept"] for r in held_out)
    assert right / len(held_out) >= 0.95


def test_nothing_to_learn(spark):
    docs = corpus(spark, 60, 1).drop("quality")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one_kind = docs.select("doc_id", F.lit(1).alias("quality"))
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    for labels in (none, one_kind, odd):
        assert q.learn(docs, labels, learn_from=F.lit(True)).rules == ()
    assert q.learn(docs.limit(0), one_kind, learn_from=F.lit(True)).rules == ()
    assert q.judge(docs.limit(0), q.RuleList()).count() == 0


def test_repeated_ids_conflicting_labels_and_extra_columns(spark):
    docs = corpus(spark, 300, 9)
    labels = docs.select("doc_id", "quality")
    noisy = labels.union(labels).union(labels.withColumn("quality", 1 - F.col("quality")))  # two of three votes are right
    extra = docs.drop("quality").selectExpr("*", "1 AS s", "'x' AS bad", "2 AS label_id", "3 AS n_words")
    plain_rules = q.learn(docs.drop("quality"), labels, learn_from=F.lit(True))
    assert q.learn(extra.union(extra), noisy, learn_from=F.lit(True)).rules == plain_rules.rules
    judged = q.judge(extra, plain_rules)
    assert judged.columns == [*extra.columns, "judged"] and judged.count() == 300


def test_no_python_in_the_plan(spark):
    docs = corpus(spark, 60, 2)
    rules = q.RuleList(((q.Condition("symbols", True, 0.1), q.Condition("marks", False, 0.2)),))
    plan = q.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
