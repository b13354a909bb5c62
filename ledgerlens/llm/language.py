"""Language of words, spans and documents.

Each word gets a score per language: the log-probability of its letter groups under the language's model. The word's script
narrows the languages to those that are written in it. A Viterbi pass with a fixed penalty for every switch then labels the
words, so foreign words inside a sentence keep the sentence's language and foreign passages get their own span. The
document's language is the one with most letters.

The model is learned from about `sample_rows` rows picked by hash (a parameter) and holds all letter groups of those, hashed
into `width` places, which takes four bytes for each place and language. Prediction covers whole texts. The pass runs for many documents at once, one word of each per step; its
memory follows HELD_WORDS, or one document's words where that is more.

A word is a run of letters and the marks that go with them (Unicode categories L and M) with a letter in it; digits, numerals
such as one half and signs are none.

Defined cases: a null text, a text without letters and a model without languages give `und` with score 0 and no span; ties go
to the language that comes first in the alphabet; repeated rows are judged each; an empty table gives an empty result. Only
the text column enters a prediction; language values that are null are not learned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import texts
from ledgerlens.session import cut_lineage

WORDS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")
WIDTH = 1 << 20
#: fixed values: first and last code points of scripts; anything else is written in "other"
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("latin", 0x1E00, 0x1EFF),
)
UNKNOWN = "und"
SWITCH_PENALTY = 6.0
#: Share of a language's words that a script needs for the language to be a candidate in it.
SCRIPT_SHARE = 0.001
HELD_WORDS = 600_000
CACHE_WORDS = 200_000
PREDICTION = "lang_pred string, score double, spans array<struct<lang:string,first_word:int,n_words:int>>"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def script(word: str) -> str:
    code = ord(word[0])
    return next((name for name, a, b in SCRIPTS if a <= code <= b), "other")


def letter_groups(word: str) -> list[str]:
    """Runs of three letters of the word between blanks, and the word itself."""
    padded = f" {word} "
    return [padded[k : k + 3] for k in range(len(padded) - 2)] + [padded]


def place(group: str, width: int) -> int:
    """Row of a letter group, the same here and in SQL."""
    return crc32(group.encode()) % width


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  #: log-probability by place of a letter group and language
    scripts: dict[str, np.ndarray]  #: which languages are candidates in a script


class WordScores:
    """Words as rows of a growing matrix of scores; scores of new words are computed together."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.new: list[str] = []
        self.matrix = np.empty((0, len(self.model.languages)))

    def ids(self, words: list[str]) -> np.ndarray:
        rows, new = self.rows, self.new
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            row = rows.get(w)
            if row is None:
                row = rows[w] = len(rows)
                new.append(w)
            out[k] = row
        return out

    def settle(self) -> np.ndarray:
        if self.new:
            m = self.model
            width = len(m.scores)
            found = [[place(g, width) for g in letter_groups(w)] for w in self.new]
            sizes = np.array([len(f) for f in found])
            flat = m.scores[np.concatenate([np.array(f) for f in found])]
            rows = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / 2  # groups overlap
            everyone = np.ones(len(m.languages), bool)
            candidates = np.array([m.scripts.get(script(w), everyone) for w in self.new])
            self.matrix = np.concatenate([self.matrix, np.where(candidates, rows, -1e6)])
            self.new.clear()
        return self.matrix


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word. `scores` holds the documents' words one after the other; documents are not linked."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, ends = starts[order], lengths[order]
    steps = int(ends[0]) if len(ends) else 0
    active = np.searchsorted(-ends, -np.arange(steps), side="left")  # documents that have a word at each step
    kind = np.min_scalar_type(-max(scores.shape[1], 1))  # holds any language's number
    came = np.empty(scores.shape, kind)  # best predecessor of each language at each word
    own = np.arange(scores.shape[1], dtype=kind)
    value = scores[starts[: active[0]]] if steps else scores
    final = np.zeros(len(ends), kind)
    for t in range(steps):
        n = active[t]
        if t:
            ended = slice(n, len(value))
            final[ended] = value[ended].argmax(axis=1)
            value = value[:n]
            best = value.argmax(axis=1)
            jump = value[np.arange(n), best] - penalty
            stay = value >= jump[:, None]
            at = starts[:n] + t
            came[at] = np.where(stay, own, best[:, None].astype(kind))
            value = np.where(stay, value, jump[:, None]) + scores[at]
    if steps:
        final[: len(value)] = value.argmax(axis=1)
    out = np.empty(len(scores), kind)
    state = final.copy()
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return out


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    scripts: Counter = Counter()
    for part, values in texts(batches):
        for text, lang in zip(values, part.column("lang").to_pylist()):
            words = Counter(words_of(text))
            own = counts.setdefault(lang, Counter())
            for word, n in words.items():
                scripts[lang, script(word)] += n
                for group in letter_groups(word):
                    own[group] += n
    rows = [(lang, g, n, False) for lang, own in counts.items() for g, n in own.items()] + [(*k, n, True) for k, n in scripts.items()]
    for k in range(0, len(rows), 50_000):
        part = rows[k : k + 50_000]
        yield pa.record_batch([pa.array([r[j] for r in part], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))],
                              ["lang", "item", "n", "is_script"])


def fit(docs: DataFrame, learn: Column, sample_rows: int = 20_000, width: int = WIDTH, text_col: str = "text",
        lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """`learn` is a condition over `docs` that picks the rows to learn from."""
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = min(1.0, sample_rows / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = cut_lineage(sample.mapInArrow(_group_counts, "lang string, item string, n long, is_script boolean").groupBy(
        "lang", "item", "is_script").agg(F.sum("n").alias("n")), "language-groups")
    groups = counted.where("not is_script")
    seen = groups.agg(F.count_distinct("item")).first()[0]
    totals = {r.lang: r.total for r in groups.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    # at most width rows for each language
    at = F.pmod(F.crc32(F.col("item").cast("binary")), F.lit(width)).cast("int")
    rows = groups.groupBy("lang", at.alias("place")).agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((width, len(languages)), np.float32)
    if languages:
        number = {lang: k for k, lang in enumerate(languages)}
        n[rows["place"].to_numpy(), [number[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    total = np.array([totals[x] for x in languages], np.float32)
    scores = np.log((n + np.float32(0.5)) / (total + np.float32(0.5 * (seen + 1)))) if languages else n
    scripts: dict[str, np.ndarray] = {}
    words = {}
    for r in counted.where("is_script").collect():
        words[r.lang, r.item] = r.n
    for name in {s for _, s in words}:
        mine = np.array([words.get((x, name), 0) / sum(v for (y, _), v in words.items() if y == x) >= SCRIPT_SHARE for x in languages])
        if mine.any():
            scripts[name] = mine
    return Model(languages, scores, scripts)


def _predicted(shared, penalty: float):
    def judged(own: Model, words: WordScores, held: list[list[str]]) -> list[tuple]:
        lengths = np.array([len(h) for h in held])
        ids = words.ids([w for h in held for w in h])
        scores = words.settle()[ids] if own.languages else np.empty((0, 0))
        full = np.flatnonzero(lengths)
        labels = viterbi(scores, lengths[full], penalty) if len(full) and own.languages else np.empty(0, np.int8)
        out, at = [], 0
        for h in held:
            if not h or not own.languages:
                out.append((UNKNOWN, 0.0, []))
                continue
            mine = labels[at : at + len(h)]
            letters = np.bincount(mine, weights=np.fromiter(map(len, h), float, len(h)), minlength=len(own.languages))
            at += len(h)
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(mine)]]))
            best = int(letters.argmax())
            out.append((own.languages[best], float(letters[best] / letters.sum()),
                        [{"lang": own.languages[x], "first_word": int(f), "n_words": int(s)} for x, f, s in zip(mine[first], first, sizes)]))
        if len(words.rows) > CACHE_WORDS:
            words.clear()
        return out

    @F.pandas_udf("struct<lang_pred:string,score:double,spans:array<struct<lang:string,first_word:int,n_words:int>>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        words = WordScores(own)
        for part in parts:
            done, held, size = [], [], 0
            for text in part:
                held.append(words_of(text))
                size += len(held[-1])
                if size > HELD_WORDS:
                    done += judged(own, words, held)
                    held, size = [], 0
            done += judged(own, words, held)
            yield pd.DataFrame({"lang_pred": [d[0] for d in done], "score": [d[1] for d in done], "spans": [d[2] for d in done]})

    return run


def predict(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (share of letters in that language) and the labelled spans of every row."""
    run = _predicted(docs.sparkSession.sparkContext.broadcast(model), penalty)
    found = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col).cast("string")).alias("x"))
    return found.select("doc_id", "x.lang_pred", "x.score", "x.spans")
