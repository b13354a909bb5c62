"""Minimum cuts against enumeration, pages with known articles, packing invariants."""

from __future__ import annotations

import html
import random
import re
import time
from itertools import product

import pytest

from ledgerlens.llm import packing, pagecut, queries

SMALL = "/root/testdata/sf0.001"


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 9)
        scores = [round(rng.uniform(-2, 2), 3) for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda side: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, side)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost(pagecut.cut(scores, edges)) == pytest.approx(min(cost(s) for s in product([False, True], repeat=n)))


PARAGRAPHS = ["The first paragraph has words &amp; more words, enough to be read.", "A second one.", "Finally   the\n third <b>bold</b> bit<br>and the rest of it, which is long."]
WANT = "Title here\nThe first paragraph has words & more words, enough to be read.\nA second one.\nFinally the third bold bit and the rest of it, which is long."


@pytest.mark.parametrize("around", [
    "<article><h1>Title here</h1>{}</article>", "<main><div class='post-content'><h1>Title here</h1>{}</div></main>",
    "<div id=content><h2>Title here</h2>{}</div>",
])
@pytest.mark.parametrize("noise", [
    "", "<aside><p>About the author, who writes long sentences about things.</p></aside>", "<div class='ad'>Buy now, a long advert sentence. It goes on.</div>",
    "<section id='comments'><h3>Comments</h3><article class='comment'><p>I like this article, said the reader at great length.</p></article></section>",
    "<form><label>Mail</label><input><button>Send</button></form>", "<div class='cookie-notice'><p>We use cookies, as everyone does, for many reasons.</p></div>",
    "<div class=sidebar><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>", "<!-- <p>gone</p> --><script>var x='<p>no</p>'</script>",
])
def test_article_is_found(around, noise):
    page = ("<!DOCTYPE html><html><head><title>Other</title><style>p{}</style></head><body><header><p>Site name, the best site of all.</p></header>"
            "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>" + noise
            + around.format("<p>" + "<p>".join(PARAGRAPHS) + "</p>") + noise + "<footer>&copy; someone. All rights reserved.</footer></body></html>")
    assert pagecut.main_text(page) == WANT


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p", ""), ("<script>never closed", ""), ("<div class='x", ""),
    ("<article><p>5 &lt; 6 and &#233;&nbsp;&eacute; hold.</p></article>", "5 < 6 and é é hold."),
])
def test_odd_pages(page, want):
    assert pagecut.main_text(page) == want
    pagecut.main_text("<div>" * 3000 + "x" + "<p a='" * 500)


def test_query_on_the_small_pages(spark):
    rows = queries.op5_html_extraction(spark, SMALL).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)
        cut = re.split(r"</?(?:h1|p)[^>]*>", re.sub(r"<br>|</?b>", " ", article[1]))
        want = "\n".join(t for t in (" ".join(html.unescape(c).split()) for c in cut) if t)
        assert (r.text, r.n_chars) == (want, len(want))


def check_packing(rows, tokens):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.bin_id, []).append(r)
    for members in by_bin.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == [sum(m.n_tokens for m in members[:k]) for k in range(len(members))]
        used = sum(r.n_tokens for r in members)
        assert {r.bin_tokens for r in members} == {used}
        assert {r.capacity for r in members} == {min(c for c in packing.LENGTHS if c >= used)}
    for doc, n in tokens.items():
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.start for r in parts] == [4096 * k for k in range(len(parts))] and sum(r.n_tokens for r in parts) == n
    return sum(tokens.values()) / sum(m[0].capacity for m in by_bin.values())


def test_packing_keeps_every_token(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = queries.op1_packing(spark, SMALL).collect()
    fill = check_packing(rows, {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1 for r in docs})
    assert fill > 0.9


def test_packing_defined_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "w " * 9000, 5), (3, "w " * 9000, 5), (None, "a b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = packing.pack(docs, group_tokens=4000).collect()
    assert sum(r.n_tokens for r in got) == 1 + 1 + 2 * 9001 + 3
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, final = packing.best_fit([6, 5, 4, 3], (4, 8, 10), cost=lambda c: c)
    assert bins == [0, 1, 2, 1] and offsets == [0, 0, 0, 5] and final == [8, 8, 4]
    assert packing.best_fit([], (4, 8)) == ([], [], [])


def test_equal_rows_are_spread_over_groups(spark):
    docs = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'' as text")
    got = packing.pack(docs, group_tokens=1000).selectExpr("bin_id >> 32 as g").groupBy("g").count().collect()
    assert len(got) == 20 and max(r["count"] for r in got) < 2000 and sum(r["count"] for r in got) == 20_000


def test_ids_stay_as_they_are_beside_nulls(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b"), (None, "c"), (5, "d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in packing.pack(docs).collect()) == [0, 5, big]
    names = spark.createDataFrame([("x", "a b"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack(names).collect()} == {"x", None}


def test_places_do_not_depend_on_how_rows_are_read(spark):
    rows = [(k if k % 7 else None, "w " * (k % 90)) for k in range(1500)] + [(None, "")] * 9000 + [(3, "w w")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, packing.pack(docs.coalesce(1), group_tokens=1 << 12).collect()))
    five = sorted(map(str, packing.pack(docs.repartition(5), group_tokens=1 << 12).collect()))
    assert one == five and len(one) == len(rows)
    bins = [r.bin_id >> 32 for r in packing.pack(docs, group_tokens=1 << 12).collect()]
    assert max(bins.count(b) for b in set(bins)) < 3000  # equal rows are spread


def test_best_fit_against_all_packings():
    """Small inputs: no assignment of pieces to bins is more than a bin's start cheaper, and the hand-made one is optimal."""
    def cheapest(sizes, lengths):
        best = [float("inf")]

        def go(k, loads):
            if k == len(sizes):
                best[0] = min(best[0], sum(packing.cost(next(c for c in lengths if c >= x)) for x in loads))
                return
            for j in range(len(loads)):
                if loads[j] + sizes[k] <= lengths[-1]:
                    go(k + 1, loads[:j] + [loads[j] + sizes[k]] + loads[j + 1 :])
            go(k + 1, [*loads, sizes[k]])

        go(0, [])
        return best[0]

    rng, lengths = random.Random(5), (64, 128, 256)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 200) for _ in range(rng.randint(1, 6))), reverse=True)
        bins, offsets, final = packing.best_fit(sizes, lengths)
        for b in range(len(final)):
            mine = [(o, n) for x, o, n in zip(bins, offsets, sizes) if x == b]
            assert sorted(mine) == sorted((sum(n for _, n in mine[:k]), mine[k][1]) for k in range(len(mine)))
            assert final[b] == next(c for c in lengths if c >= sum(n for _, n in mine))
        assert sum(map(packing.cost, final)) <= 1.6 * cheapest(sizes, lengths)


ARTICLE = "<article><h1>Title</h1><p>Some long text of the article, with words and more. It goes on for long.</p></article>"


@pytest.mark.parametrize("names", ["content-with-sidebar", "layout-with-sidebar", "post share-enabled", "page no-comments", "form-factor-desktop",
                                   "has-ads", "sidebar wrapper", "comments-page"])
def test_class_names_around_an_article(names):
    want = "Title\nSome long text of the article, with words and more. It goes on for long."
    assert pagecut.main_text(f"<div class='{names}'>{ARTICLE}</div><footer>All rights</footer>") == want
    assert pagecut.main_text(f"<body class='{names}'><main>{ARTICLE}</main><div class=sidebar><p>Not this, it is beside the text.</p></div>") == want


def test_quotes_open_values_only_after_an_equals_sign():
    page = "<article><p title=it's>Second paragraph isn't lost, it is here.</p><p data-x = \"a>b\" class='c>d'>And one \"more\" of them.</p></article>"
    assert pagecut.main_text(page) == "Second paragraph isn't lost, it is here.\nAnd one \"more\" of them."


@pytest.mark.parametrize("tag", ["noscript", "object", "template", "iframe"])
def test_fallback_content_is_judged_like_any_other(tag):
    page = f"<article><p>One two three four five six seven eight, nine.</p><{tag}><p>There is text of the article in here too.</p></{tag}></article>"
    assert pagecut.main_text(page) == "One two three four five six seven eight, nine.\nThere is text of the article in here too."


@pytest.mark.parametrize("page", ["<div>" * 8000 + "x", "<font>" * 8000 + "<p>text of a paragraph.</p>" * 50, "<div>text here<font>" * 8000,
                                  "<li>" * 8000, "<p><table><td>" * 3000, "</i>" * 8000 + "<b>" * 8000 + "</i>" * 8000])
def test_deep_pages_take_little_time(page):
    start = time.time()
    pagecut.main_text(page)
    assert time.time() - start < 2  # well below on an idle machine


def test_long_chain_of_undecided_blocks():
    rng = random.Random(3)
    scores = [rng.choice([-0.5, 0.5]) for _ in range(4000)]
    start = time.time()
    side = pagecut.cut(scores, [(k, k + 1, 1.0) for k in range(3999)])
    assert time.time() - start < 3
    # the cost of a chain's cut by dynamic programming
    best = [max(-scores[0], 0), max(scores[0], 0)]  # kept, left out
    for s in scores[1:]:
        best = [min(best[0], best[1] + 1) + max(-s, 0), min(best[1], best[0] + 1) + max(s, 0)]
    cost = sum(max(-s, 0) if k else max(s, 0) for s, k in zip(scores, side)) + sum(a != b for a, b in zip(side, side[1:]))
    assert cost == pytest.approx(min(best))
