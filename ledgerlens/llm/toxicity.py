"""Toxicity by the nearest labelled examples.

A vocabulary of words and word beginnings that mark toxic examples is chosen by a log-likelihood test on a labelled sample.
Texts and examples are TF-IDF vectors over it, with document frequencies counted over the whole corpus. The nearest examples
by exact cosine come from an inverted index cut into blocks with the largest weight per term and block: blocks are visited by
falling upper bound until no block can reach the k-th best. Votes weighted by distance are mapped to a probability by a
monotone fit on the examples, each scored without itself.

Bounds, all parameters: about `sample_rows` labelled rows, at most `vocabulary` features, `k` neighbours (and all that tie
with the last). Everything the driver or a broadcast holds follows from these, not from the corpus.

Defined cases: a null or empty text, like one without a known feature, has no neighbours and gets the share of toxic examples
among those without features; labels that are null are ignored, several labels of one id count as their largest; without
toxic and clean examples the score is the share known (0 when none is); repeated rows are scored each; ties are all counted;
an empty table gives an empty result. Only the text column enters a score, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import InitVar, dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Cache, array_texts, texts
from ledgerlens.session import cut_lineage

TOKEN = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
BLOCK = 64
#: Features a worker counts before it hands the counts on.
HELD_FEATURES = 50_000
SCORE = "score double, evidence array<long>"


def word_features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


@dataclass
class Index:
    """Unit vectors of the examples with features, in blocks; `best` is exact."""

    ids: np.ndarray
    toxic: np.ndarray
    rows: InitVar[list[dict[int, float]]]  #: kept as postings only, since each worker holds an index
    k: int
    #: postings of all terms one after the other, ordered by example within a term
    at: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)
    row_of: dict[int, int] = field(init=False)
    #: where a term's postings of a block begin, and the largest weight among them
    begin: np.ndarray = field(init=False)
    highest: np.ndarray = field(init=False)

    def __post_init__(self, rows):
        flat = sorted((term, at, weight) for at, row in enumerate(rows) for term, weight in row.items())
        self.row_of = {t: k for k, t in enumerate(dict.fromkeys(f[0] for f in flat))}
        term = np.array([self.row_of[f[0]] for f in flat], np.int64)
        self.at, self.weight = np.array([f[1] for f in flat], np.int64), np.array([f[2] for f in flat])
        blocks = -(-len(self.ids) // BLOCK)
        cell = term * blocks + self.at // BLOCK
        self.begin = np.searchsorted(cell, np.arange(len(self.row_of) * blocks + 1))
        highest = np.zeros(len(self.row_of) * blocks)
        np.maximum.at(highest, cell, self.weight)
        self.highest = highest.reshape(len(self.row_of), blocks)

    def _scored(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines with the examples of the given blocks; zero elsewhere."""
        cells = (terms[:, None] * self.highest.shape[1] + blocks[None, :]).ravel()
        start, size = self.begin[cells], self.begin[cells + 1] - self.begin[cells]
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
        each = np.repeat(np.repeat(weights, len(blocks)), size)
        return np.bincount(self.at[places], weights=each * self.weight[places], minlength=len(self.ids))

    def best(self, query: dict[int, float], leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples and of those that tie with the last, nearest first."""
        known = [(self.row_of[t], w) for t, w in query.items() if t in self.row_of]
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        terms, weights = np.array([t for t, _ in known]), np.array([w for _, w in known])
        bound = weights @ self.highest[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        cos, done, step, kth = np.zeros(len(self.ids)), 0, 4, 0.0
        while done < len(order) and bound[order[done]] >= kth - 1e-9:
            cos += self._scored(terms, weights, order[done : done + step])
            done, step = done + step, step * 2
            if leave_out >= 0:
                cos[leave_out] = 0
            if len(cos) >= self.k:
                kth = np.partition(cos, -self.k)[-self.k]
        cos = np.round(cos, 9)
        at = np.flatnonzero(cos)
        if len(at) > self.k:
            at = at[cos[at] >= np.partition(cos, -self.k)[-self.k]]
        at = at[np.lexsort((at, -cos[at]))]
        return at, cos[at]

    def vote(self, query: dict[int, float], prior: float, leave_out: int = -1) -> tuple[float, list[int]]:
        """Share of toxic among the neighbours, nearer ones counting more, and the ids of the nearest."""
        at, cos = self.best(query, leave_out)
        if not len(at):
            return prior, []
        weight = 1.0 / (1.05 - cos)
        return float((weight * self.toxic[at]).sum() / weight.sum()), self.ids[at[:5]].tolist()


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    index: Index | None
    prior: float
    cuts: np.ndarray  #: raw votes at which the calibrated score steps up
    levels: np.ndarray

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(c)) * self.idf[t] for t, c in sorted(counts.items())}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        if self.index is None or not counts:
            return self.prior, []
        raw, evidence = self.index.vote(self.vector(counts), self.prior)
        return (raw if not evidence else self.calibrated(raw)), evidence

    def calibrated(self, raw: float) -> float:
        if not len(self.cuts):
            return raw
        return float(self.levels[max(0, np.searchsorted(self.cuts, raw, side="right") - 1)])


def monotone_fit(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing fit of labels on raw votes (pooling of adjacent violators), slightly smoothed."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # start, sum, n
    for r, y in zip(raw[order], label[order]):
        if pools and pools[-1][3] == r:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([r, y, 1, r])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, n, last = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
            pools[-1][3] = last
    levels = np.array([(s + 0.5 * (s / n)) / (n + 0.5) for _, s, n, _ in pools])
    return np.array([p[0] for p in pools]), levels


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature the numbers of toxic and clean examples that have it, in parts of this partition."""
    def counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(seen), pa.string()), pa.array([n[0] for n in seen.values()], pa.int64()),
                                pa.array([n[1] for n in seen.values()], pa.int64())], ["feature", "n1", "n0"])

    seen: dict[str, list[int]] = {}
    for part, values in texts(batches):
        for text, toxic in zip(values, part.column("toxic").to_pylist()):
            for feature in {f for w in set(tokens(text)) for f in word_features(w)}:
                seen.setdefault(feature, [0, 0])[0 if toxic else 1] += 1
            if len(seen) > HELD_FEATURES:
                yield counted(seen)
                seen.clear()
    if seen:
        yield counted(seen)


def _example_terms(terms: dict[str, int]):
    """Each example with the features it has and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(terms)
        for part, values in texts(batches):
            found = [counts(text) for text in values]
            yield pa.record_batch([part.column("example"), part.column("toxic"), pa.array([list(c) for c in found], pa.list_(pa.int32())),
                                   pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["example", "toxic", "terms", "n"])

    return run


class Counts:
    """Text -> counts of the vocabulary's features."""

    def __init__(self, terms: dict[str, int]):
        heads = {t[: PREFIXES[0]] for t in terms}  # every feature of a word begins as the word does

        def known(chunk: str) -> tuple[int, ...]:
            words = (chunk,) if chunk.isalnum() else TOKEN.findall(chunk)
            return tuple(terms[f] for w in words if w[: PREFIXES[0]] in heads for f in word_features(w) if f in terms)

        self.cache = Cache(known)

    def __call__(self, text: str | None) -> dict[int, int]:
        found: Counter = Counter()
        for hit in filter(None, map(self.cache.__getitem__, (text or "").lower().split())):
            found.update(hit)
        self.cache.trim()
        return found


def _document_frequencies(terms: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, df, n = Counts(terms), np.zeros(len(terms) + 1, np.int64), 0
        for _, values in texts(batches):
            for text in values:
                df[list(counts(text))] += 1
                n += 1
        df[-1] = n
        yield pa.record_batch([pa.array(np.arange(len(df)), pa.int64()), pa.array(df)], ["term", "df"])

    return run


def labelled_sample(labels: DataFrame, learn: Column, sample_rows: int, id_col: str, label_col: str) -> DataFrame:
    """About `sample_rows` labelled ids at most, chosen by their hash, with the label as a boolean."""
    usable = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("example")).agg((F.max(label_col) > 0).alias("toxic"))
    usable = cut_lineage(usable, "toxicity-labels")
    share = min(1.0, sample_rows / max(1, usable.count()))
    return usable.where(F.pmod(F.xxhash64("example"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = 12_000, vocabulary: int = 2_000, k: int = 25, least_share: float = 0.5,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """`learn` is a condition over `labels` that picks the rows labels may be learnt from. A feature must be toxic in more
    than `least_share` of the examples that have it."""
    sample = labelled_sample(labels, learn, sample_rows, id_col, label_col)
    text = F.col(text_col).cast("string").alias("text")
    # the sample is bounded by sample_rows
    examples = cut_lineage(docs.select(F.col(id_col).alias("example"), text).join(F.broadcast(sample), "example"), "toxicity-examples")
    totals = {r.toxic: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    if not n1 or not n0:
        return Model({}, np.empty(0), None, float(bool(n1)), np.empty(0), np.empty(0))
    rate = n1 / (n1 + n0)
    counted = cut_lineage(examples.mapInArrow(_feature_counts, "feature string, n1 long, n0 long").groupBy("feature").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "toxicity-features")
    n = F.col("n1") + F.col("n0")
    log = lambda c, p: F.when(c > 0, c * F.log(c / (n * p))).otherwise(0.0)
    # few of all tested features pass by luck
    least = 1.6 * math.log(max(2, counted.count()))
    chosen = counted.withColumn("gain", 2 * (log(F.col("n1"), rate) + log(F.col("n0"), 1 - rate))).where(
        (F.col("n1") > n * max(rate, least_share)) & (F.col("gain") > least)).orderBy(F.desc("gain"), "feature").limit(vocabulary)
    terms = {r.feature: i for i, r in enumerate(chosen.select("feature").collect())}

    df = docs.select(text).mapInArrow(_document_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    seen = np.zeros(len(terms) + 1)
    for r in df.collect():
        seen[r.term] = r.df
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    model = Model(terms, idf, None, rate, np.empty(0), np.empty(0))
    vectors = examples.select(F.col("example").cast("long"), "toxic", "text").mapInArrow(
        _example_terms(terms), "example long, toxic boolean, terms array<int>, n array<int>").orderBy("example", "toxic").collect()  # the sample
    with_terms = [(r.example, r.toxic, model.vector(dict(zip(r.terms, r.n)))) for r in vectors if r.terms]
    without = [r.toxic for r in vectors if not r.terms]
    model.prior = (sum(without) + rate) / (len(without) + 1)
    # examples with the same strongest feature stand together, which keeps the blocks' bounds tight
    with_terms.sort(key=lambda e: (max(e[2], key=lambda t: (e[2][t], -t)), e[0]))
    if with_terms:
        model.index = Index(np.array([e[0] for e in with_terms]), np.array([float(e[1]) for e in with_terms]), [e[2] for e in with_terms], k)
        raw = [model.index.vote(e[2], model.prior, leave_out=i)[0] for i, e in enumerate(with_terms)]
        model.cuts, model.levels = monotone_fit(np.array(raw), np.array([float(e[1]) for e in with_terms]))
    return model


def scorer(docs: DataFrame, model: Model):
    """A function of a text column that gives struct(score, evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{SCORE.replace(' double', ':double').replace(' array', ':array')}>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        counts, known = Counts(own.terms), {}
        for part in array_texts(parts):
            out = []
            for text in chain.from_iterable(part):
                c = counts(text)
                key = tuple(sorted(c.items()))
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = own.score(c)
                out.append(known[key])
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))],
                                             ["score", "evidence"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted (1 from 0.5 on) and the ids of the nearest examples."""
    run = scorer(docs, model)
    scored = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col).cast("string")).alias("x"))
    return scored.select("doc_id", "x.score", (F.col("x.score") >= 0.5).cast("int").alias("predicted"), "x.evidence")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without the rows predicted toxic, columns as they were."""
    run = scorer(docs, model)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = docs.select(row.alias("row"), run(F.col(text_col).cast("string")).alias("x"))
    return scored.where("x.score < 0.5").select("row.*")
