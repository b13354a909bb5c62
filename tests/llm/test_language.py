"""The Viterbi pass against enumeration, spans of mixed text, accuracy on rows held out."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


def test_best_path_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 6, 1, 5])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    got, at = language.viterbi(scores, lengths, 2.0), 0
    value = lambda path, s: sum(s[k, x] for k, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
    for n in lengths:
        s = scores[at : at + n]
        best = max(value(p, s) for p in product(range(3), repeat=int(n)))
        assert np.isclose(value(got[at : at + n].tolist(), s), best)
        at += n


def test_held_out_accuracy_and_mixed_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = queries.op6_language(spark, FOLDER).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    model = language.fit(docs, F.lit(True))
    one, two = [next(r.text for r in rows if r.lang == x and 300 < len(r.text) < 3000 and r.score == 1) for x in ("de", "es")]
    both = language.predict(spark.createDataFrame([(1, f"{one} {two}")], "doc_id long, text string"), model).first()
    assert [s.lang for s in both.spans] == ["de", "es"]
    assert sum(s.n_words for s in both.spans) == len(language.words_of(f"{one} {two}"))


def test_defined_cases(spark):
    rows = [(1, "alpha beta gamma", "xx", 1), (2, "альфа бета", "yy", 1), (3, None, "xx", 1), (4, "123 --", None, 1), (5, "", "yy", 1), (None, "beta", None, 1)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()}
    assert got == {1: ("xx", 1.0), 2: ("yy", 1.0), 3: ("und", 0.0), 4: ("und", 0.0), 5: ("und", 0.0), None: ("xx", 1.0)}
    none = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), none).count() == 0


def test_numerals_are_no_letters_and_marks_stay_in_words(spark):
    assert language.words_of("½ ² ① 3x नमस्ते กำลัง é\u0301a _b_") == ["x", "नमस्ते", "กำลัง", "é\u0301a", "b"]
    docs = spark.createDataFrame([(1, "alpha beta", "en"), (2, "½ ² ①", None), (3, "①", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs, F.lit(True))).collect()}
    assert got == {1: ("en", 1.0), 2: ("und", 0.0), 3: ("und", 0.0)}


def test_more_languages_than_a_byte_counts(spark):
    """140 languages with an alphabet of their own letters each; every one is told apart."""
    words = {f"l{k:03}": " ".join(chr(0x4E00 + 40 * k + (i * j) % 40) * 3 for i in range(1, 12) for j in (1, 3)) for k in range(140)}
    docs = spark.createDataFrame([(k, text, lang) for k, (lang, text) in enumerate(words.items())], "doc_id long, text string, lang string")
    found = language.predict(docs, language.fit(docs, F.lit(True), width=1 << 16)).collect()
    assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)] == list(words)
