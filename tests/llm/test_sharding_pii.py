"""Sharding and personal data against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import pii, queries, sharding

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, size int, shard string"

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def expected(text: str | None) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


HARD = [
    None, "", "a@b.c..d@e.f", "a@b.co_x@y.z", "x@y", "..a@-.-", "é𝄞 mail me: a.b+c@d-e.org, ok", "1.2.3.4.5.6.7.8 and 256.1.1.1 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (555) 123-4567. +12 +123456789012345678",
    "+4(((((((((", "9" * 20000, "a" * 20000, "a." * 9000 + "@" + "b." * 9000 + "c", "1-" * 9000, "+1" * 6000, "@@@@", "000.000.00001.0255",
    "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433", "𝄞" * 50 + "z@z.zz",
]


def test_spans_equal_plain_python(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(HARD)] + [(3, HARD[3], 1, "x"), (None, "q@q.qq", None, None)], SCHEMA)
    rows = pii.digest(pii.find(docs)).collect()
    assert len(rows) == len(HARD) + 2
    for r in rows:
        text = "q@q.qq" if r.doc_id is None else HARD[r.doc_id]
        want = expected(text)
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("iban")] == want, (r.doc_id, spans, want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    iban = next(r for r in rows if r.doc_id == HARD.index("IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433"))
    assert iban.n_iban == 1 and "iban:5:32" in iban.spans


def test_spans_over_the_small_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op8_pii(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == expected(texts[r.doc_id])


def test_redaction_masks_and_keeps_nulls(spark):
    docs = spark.createDataFrame([(1, "to a@b.co now", 5), (2, None, None), (3, "card 4111 1111 1111 1111.", 0)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert got == {1: ("to [EMAIL] now", 14), 2: (None, None), 3: ("card [CARD].", 12)}
    assert pii.redact(docs).schema == docs.schema


def test_shards_are_even_and_gapless(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op2_sharding(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by.setdefault(r.shard, []).append(r)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    largest = max(r.size for r in rows)
    loads = [sum(r.size for r in by.get(s, [])) for s in range(16)]
    assert max(loads) <= max(largest, 1.02 * sum(loads) / 16)


def test_shards_defined_cases(spark):
    rows = [(None, "a", 1, "x"), (1, None, 2, "y"), (1, None, 2, "y"), (2, "", 0, None)]
    got = sharding.assign(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert sorted(r.size for r in got) == [1, 1, 1, 2]
    assert sharding.assign(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_rebalance_moves_only_what_must(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 90 as int))").alias("text"))
    sizes = sharding.slot_bytes(sharding.record_sizes(docs)).cache()
    one = sharding.store_map(sharding.first_map(sizes, 4), str(tmp_path / "map"))
    two = sharding.store_map(sharding.rebalance(one, sizes, 5), str(tmp_path / "map"))
    a = {r.vslot: r.shard for r in one.where("version = 1").collect()} or None
    b = {r.vslot: r.shard for r in two.collect()}
    assert {r.version for r in two.collect()} == {2} and len(b) == sharding.VIRTUAL_SLOTS
    old = {r.vslot: r.shard for r in spark.read.parquet(str(tmp_path / "map")).where("version = 1").collect()}
    weight = {r.vslot: r.bytes for r in sizes.collect()}
    loads = [sum(weight[v] for v in b if b[v] == s) for s in range(5)]
    assert max(loads) <= 1.05 * sum(loads) / 5 and a is None or a
    moved = sum(weight[v] for v in b if b[v] != old[v])
    assert moved <= 0.3 * sum(loads)


def test_assign_uses_and_edits_the_stored_map(spark, tmp_path):
    folder = str(tmp_path / "stored")
    docs = spark.createDataFrame([(i, "w" * (i % 50), 1, "x") for i in range(400)], SCHEMA)
    first = {r.doc_id: (r.shard, r.slot, r.map_version) for r in sharding.assign(docs, 4, folder).collect()}
    again = sharding.assign(docs, 4, folder).collect()
    assert len(again) == 400 and {r.doc_id: (r.shard, r.slot, r.map_version) for r in again} == first
    grown = sharding.assign(docs, 5, folder).collect()
    assert {r.map_version for r in grown} == {2} and {r.shard for r in grown} == set(range(5)) and len(grown) == 400
    moved = sum(r.size for r in grown if first[r.doc_id][0] != r.shard)
    assert 0.2 <= moved / sum(r.size for r in grown) < 0.25  # one shard in five is new
    # the other rows stay where they are when one shard outgrows the rest
    heavy = {r.doc_id for r in grown if r.shard == 0}
    more = docs.withColumn("text", F.when(F.col("doc_id").isin(list(heavy)), F.repeat(F.lit("x"), 200)).otherwise(F.col("text")))
    edited = sharding.assign(more, 5, folder).collect()
    assert {r.map_version for r in edited} == {3} and len(edited) == 400
    before = {r.doc_id: r.shard for r in grown}
    assert sum(r.size for r in edited if before[r.doc_id] != r.shard and before[r.doc_id] != 0) < 0.1 * sum(r.size for r in edited)
    by_shard = [sum(r.size for r in edited if r.shard == s) for s in range(5)]
    assert max(by_shard) - min(by_shard) < 0.2 * max(by_shard)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sharding.store_map(sharding.latest_map(spark, folder), folder)


def test_assign_equals_a_plain_map(spark):
    """Slots largest first to the least loaded shard, and places in slot order, told by plain Python from the same sizes."""
    docs = spark.createDataFrame([(i, "é" * (i % 37), 1, "x") for i in range(300)] + [(7, None, 1, "y")] * 2, SCHEMA)
    rows = sharding.record_sizes(docs).collect()
    for r in rows:
        text = "" if r.size == 1 else "é" * (r.doc_id % 37)
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    size = [0] * sharding.VIRTUAL_SLOTS
    for r in rows:
        size[r.vslot] += r.size
    loads, shard = [0] * 4, {}
    for v in sorted(range(len(size)), key=lambda v: (-size[v], v)):
        shard[v] = loads.index(min(loads))
        loads[shard[v]] += size[v]
    want = []
    for s in range(4):
        mine = sorted((r for r in rows if shard[r.vslot] == s), key=lambda r: (r.vslot, r.doc_id, r.text_crc32, r.size))
        want += [(r.doc_id, r.size, s, k) for k, r in enumerate(mine)]
    got = [(r.doc_id, r.size, r.shard, r.slot) for r in sharding.assign(docs, 4).collect()]
    assert sorted(got) == sorted(want)
