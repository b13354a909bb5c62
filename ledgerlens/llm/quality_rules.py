"""Quality verdicts from a learned decision list over statistics of a text.

Sequential covering: a rule is a conjunction of thresholds. It is grown on two thirds of the labelled rows by information
gain, cut back on the other third, and kept while it is right more often than not there; the rows it covers leave, and the
next rule is learned. Each step needs only counts by statistic and threshold, one small aggregation. The finished list is one
ordered CASE expression, so judging a corpus is a projection without any exchange.

Everything that touches rows is built from SQL functions. Bound: rules are learned from about `most_rows` labelled documents
(20,000), taken by a hash of the id; every document is judged by its whole text.

Defined cases: a null text counts as empty and fails the base rule; null ids and null labels are not learned from; an id with
several labels has the label of most of them (a tie counts as good); rows with one id but different texts are learned from
once (the least statistics) and judged each; without labels, or with labels of one kind, the list is empty and the base rule
decides alone. Extra columns of the input, whatever their names, are passed through by `judge` or left out by the query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let
from ledgerlens.session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Statistics that a rule may test; all are shares or means but the first.
TESTED = ("n_words", "mean_word", "mean_line", "symbols", "upper", "marks", "dup_lines", "repeats", "distinct", "bullets")
LEAST_WORDS = 50


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def _count_of(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{letters}]+", ""))


def _window_is(words: Column, a: Column, b: Column) -> Column:
    same = F.lit(True)
    for k in range(3):
        same = same & (F.get(words, a + k) == F.get(words, b + k))
    return same


def repeated_words(words: Column) -> Column:
    """Words covered by a three-word window that the array holds twice or more.

    A window is one long, the high bits a hash and the low bits its place, so sorting is a sort of primitives. Neighbours
    with one hash are compared word by word; should two different windows share a hash, the windows themselves are sorted.
    """
    n = F.size(words)
    return F.when(n < 3, F.lit(0)).otherwise(let(F.length(F.bin(n)), lambda bits: _repeated_words(words, bits)))


def _repeated_words(words: Column, bits: Column) -> Column:
    def high(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    def place(x: Column) -> Column:
        return (x - F.call_function("shiftleft", high(x), bits)).cast("int")

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def exact(meeting: Column) -> Column:
        windows = F.array_sort(F.transform(meeting, lambda x: F.struct(
            F.slice(words, place(x) + 1, 3).alias("w"), place(x).alias("p"))))
        return let(windows, lambda s: covered(F.transform(
            F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False))
                     | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))), lambda x: x["p"])))

    def from_meeting(meeting: Column) -> Column:
        clash = F.exists(F.transform(meeting, lambda x, k: F.struct(x.alias("x"), F.get(meeting, k - 1).alias("y"))), lambda z: (
            z["y"].isNotNull() & (high(z["x"]) == high(z["y"])) & ~_window_is(words, place(z["x"]), place(z["y"]))))
        return F.when(F.size(meeting) == 0, F.lit(0)).when(clash, exact(meeting)).otherwise(covered(F.transform(meeting, place)))

    def from_sorted(s: Column) -> Column:
        meets = F.filter(s, lambda x, k: F.coalesce(high(F.get(s, k - 1)) == high(x), F.lit(False))
                         | F.coalesce(high(F.get(s, k + 1)) == high(x), F.lit(False)))
        return let(meets, from_meeting)

    packed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.call_function(
        "shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")))
    return let(F.sort_array(packed), from_sorted)


def statistics(text: Column) -> Column:
    """Struct of counts over a whole text: the base counts and the statistics that rules test."""
    text = F.coalesce(text, F.lit(""))

    def counted(p: Column) -> Column:
        words, lines = p["words"], p["lines"]
        return F.struct(
            p["n_chars"].alias("n_chars"), F.size(words).alias("n_words"), F.size(lines).alias("n_lines"),
            F.length(F.array_join(words, "")).alias("word_chars"), _count_of(text, SYMBOLS).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"),
            _count_of(text, "A-Z").alias("upper"),
            _count_of(text, ".,;:!?").alias("marks"), F.size(F.array_distinct(words)).alias("distinct"),
            F.size(F.filter(words, lambda w: F.length(w) == 1)).alias("bullets"))

    def shares(c: Column) -> Column:
        return F.struct(
            *[c[k].cast("long").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            _share(c["word_chars"], c["n_words"]).alias("mean_word"), _share(c["n_words"], c["n_lines"]).alias("mean_line"),
            *[_share(c[part], c[whole]).alias(name) for name, part, whole in (
                ("symbols", "n_symbols", "n_chars"), ("upper", "upper", "n_chars"), ("marks", "marks", "n_words"),
                ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"),
                ("distinct", "distinct", "n_words"), ("bullets", "bullets", "n_words"))])

    parts = F.struct(
        F.filter(F.split(text, BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.length(text).alias("n_chars"))
    # each step is bound once: what a lambda names twice would be computed twice
    return let(let(parts, counted), shares)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self, s: Column) -> Column:
        value = s[self.statistic].cast("double")
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class RuleList:
    """Ordered rules; a text is rejected by the first whose conditions all hold."""

    rules: tuple[tuple[Condition, ...], ...] = ()
    #: labelled rows of the held-back third that each rule covered: rejected rightly, and wrongly
    evidence: tuple[tuple[int, int], ...] = field(default=())

    def fired(self, s: Column) -> Column:
        """Number of the first rule that holds, 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            holds = _all([c.column(s) for c in rule])
            out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if {' and '.join(map(str, rule))}" for k, rule in enumerate(self.rules, 1))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _labelled(docs: DataFrame, labels: DataFrame, learn: Column, most_rows: int) -> DataFrame:
    """Statistics and label of about `most_rows` labelled documents; `learn` is a condition on docs."""
    votes = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id")
        .agg(F.avg("quality").alias("share")).select(F.col("doc_id").alias("label_id"), (F.col("share") < 0.5).alias("bad")))
    votes = cut_lineage(votes, "quality-labels")
    known = votes.count()
    if known > most_rows:
        votes = votes.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(most_rows / known * (1 << 30)))
    # at most about most_rows short rows, whatever the corpus
    rows = docs.where(learn).select("doc_id", "text").join(F.broadcast(votes), F.col("doc_id") == F.col("label_id"))
    return (
        rows.select("label_id", "bad", statistics(F.col("text")).alias("s"))
        .groupBy("label_id", "bad").agg(F.min("s").alias("s")))


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, most_rows: int = 20_000, cuts: int = 32,
          most_rules: int = 12, most_conditions: int = 4, least_cover: int = 5) -> RuleList:
    """Rules that reject, learned from documents that have a label and meet `learn_from`."""
    known = cut_lineage(_labelled(docs, labels, learn_from, most_rows).where(~base_failed(F.col("s"))), "quality-statistics")
    grid = known.agg(*[
        F.percentile_approx(F.col("s")[name].cast("double"), [k / cuts for k in range(1, cuts)], 10_000).alias(name) for name in TESTED
    ]).first()
    thresholds = {name: sorted(set(grid[name] or [])) for name in TESTED}
    # the highest cut of a statistic that is mostly zero would be zero: its least positive value is a cut as well
    least = known.agg(*[F.min(F.when(F.col("s")[n] > 0, F.col("s")[n].cast("double"))).alias(n) for n in TESTED]).first()
    for name in TESTED:
        if least[name] is not None:
            thresholds[name] = sorted({*thresholds[name], least[name]})

    def level(name: str) -> Column:
        """How many cuts of a statistic its value has reached."""
        value = F.col("s")[name].cast("double")
        cut = F.array(*map(F.lit, thresholds[name])) if thresholds[name] else F.array().cast("array<double>")
        return F.size(F.filter(cut, lambda t: t <= value))

    table = known.select("s", "bad", (F.pmod(F.xxhash64("label_id", F.lit("grow")), F.lit(3)) < 2).alias("grow"),
                         F.array(*[level(name) for name in TESTED]).alias("levels"))
    open_rows = cut_lineage(table.coalesce(8), "quality-levels")
    rules, evidence = [], []
    while len(rules) < most_rules:
        rule = _grow(open_rows.where("grow"), thresholds, most_conditions, least_cover)
        if not rule:
            break
        rule, right, wrong = _prune(open_rows.where(~F.col("grow")), rule)
        if right <= wrong or right + wrong < least_cover:
            break
        rules.append(tuple(rule))
        evidence.append((right, wrong))
        open_rows = open_rows.where(~_all([c.column(F.col("s")) for c in rule]))
    return RuleList(tuple(rules), tuple(evidence))


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], most_conditions: int, least_cover: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most_conditions:
        # one row for each statistic and level: a few hundred whatever the number of rows
        counted = (
            rows.select("bad", F.posexplode("levels").alias("stat", "level"))
            .groupBy("stat", "level").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")))
        counts: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counted.collect():
            counts.setdefault(r["stat"], {})[r["level"]] = (r["p"], r["n"])
        if not counts:
            break
        p0, n0 = (sum(v[k] for v in counts[0].values()) for k in (0, 1))
        if p0 == 0 or n0 == 0 and rule:
            break
        best = None
        for stat, name in enumerate(TESTED):
            below = [0, 0]
            for j, threshold in enumerate(thresholds[name]):
                p, n = counts.get(stat, {}).get(j, (0, 0))
                below = [below[0] + p, below[1] + n]
                for at_least, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                    if p < least_cover or (p, n) == (p0, n0):
                        continue
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, Condition(name, at_least, threshold)
        if best is None:
            break
        rule.append(best[1])
        rows = rows.where(best[1].column(F.col("s")))
    return rule


def _prune(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The beginning of a rule that does best on rows it was not grown on, with its right and wrong rejections there."""
    exprs = []
    for k in range(1, len(rule) + 1):
        holds = _all([c.column(F.col("s")) for c in rule[:k]])
        exprs += [F.coalesce(F.sum((holds & F.col("bad")).cast("long")), F.lit(0)).alias(f"p{k}"),
                  F.coalesce(F.sum((holds & ~F.col("bad")).cast("long")), F.lit(0)).alias(f"n{k}")]
    found = rows.agg(*exprs).first()
    worth = [((found[f"p{k}"] - found[f"n{k}"]) / max(1, found[f"p{k}"] + found[f"n{k}"]), -k) for k in range(1, len(rule) + 1)]
    k = -max(worth)[1]
    return rule[:k], found[f"p{k}"], found[f"n{k}"]


def judge(docs: DataFrame, rules: RuleList, column: str = "judged") -> DataFrame:
    """`docs` with a struct `column`: the base counts, the base verdict, the rule that fired (0: none) and the verdict."""
    def verdict(s: Column) -> Column:
        failed = base_failed(s)
        return let(rules.fired(s), lambda fired: F.struct(
            *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"), fired.alias("rule"), (~failed & (fired == 0)).alias("kept")))

    return docs.withColumn(column, let(statistics(F.col("text")), verdict))
