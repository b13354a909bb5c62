"""Best-fit packing of documents into training sequences of several permitted lengths.

Lengths are words plus one end mark per document. Documents longer than the largest length are cut into pieces of it. Pieces
are dealt by hash into groups of about `group_tokens` tokens and each group is packed by itself, largest piece first: a
piece goes into the open bin that leaves least room; where none fits, a bin is opened, of the length whose cost for each
token it can still hope to hold is lowest. At the end every bin shrinks to the smallest permitted length that holds it.

A group is bounded whatever the input, so no task grows with it: rows that are equal in id, checksum and length are counted
and then numbered, and the number is part of the hash. Places follow from the rows alone and not from how they were read. The
price of groups is at most a few half-full bins for each, which shrinking makes cheaper.

Defined cases: null and empty texts are one end mark; equal lengths are packed by id (nulls last), then piece; repeated rows
are packed each; ids keep their type and value, beside nulls too; an empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence beyond its length: what starting one takes, and attention that grows with the square.
START_COST, SQUARE_COST = 64.0, 1 / 65536
PLACED = "piece int, start long, n_tokens long, bin_id long, offset long, capacity long, bin_tokens long"
#: Copies of one row that are numbered together.
COPIES = 4096


def cost(length: int) -> float:
    return length + START_COST + SQUARE_COST * length * length


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """For sizes in falling order: bin and offset of each, and the final length of each bin."""
    lengths = tuple(sorted(lengths))
    costs = {c: cost(c) for c in lengths}
    stacks: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by the room they have
    rooms = 0  # bit r is set when a bin has room r
    bins, offsets, used, opened = [], [], [], []
    left = sum(sizes)
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            b = len(opened)
            room = min((c for c in lengths if c >= size), key=lambda c: (costs[c] / min(c, left), c))
            opened.append(room)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        left -= size
        room -= size
        if room:
            stacks[room].append(b)
            rooms |= 1 << room
    return bins, offsets, [next(c for c in lengths if c >= u) for u in used]


def pieces(docs: DataFrame, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, n_tokens, mark (orders rows without an id), copy (tells equal rows apart)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"), F.crc32(text.cast("binary")).alias("mark"))
    counted = sized.groupBy("doc_id", "tokens", "mark").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    some = counted.withColumn("run", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / COPIES).cast("long"))))
    each = some.withColumn("copy", F.explode(F.sequence(
        F.col("run") * COPIES, F.least(F.col("n"), (F.col("run") + 1) * COPIES) - 1)))
    cut_at = F.explode(F.sequence(zero, F.floor((F.col("tokens") - 1) / longest).cast("long")))
    start = F.col("piece") * longest
    return each.withColumn("piece", cut_at).select(
        "doc_id", "mark", "copy", F.col("piece").cast("int").alias("piece"), start.alias("start"),
        F.least(F.lit(longest).cast("long"), F.col("tokens") - start).alias("n_tokens"))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, group_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: document, piece, first token and tokens, its bin, its offset there, the bin's length and contents."""
    lengths = tuple(sorted(lengths))
    parts = cut_lineage(pieces(docs, lengths[-1], id_col, text_col), "pack-pieces")
    total = parts.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    group: Column = F.pmod(F.xxhash64("doc_id", "mark", "piece", "copy"), F.lit(groups))

    def packed(rows: pa.Table) -> pa.Table:
        # Arrow keeps ids as they are; pandas would turn longs beside a null into doubles
        rows = rows.sort_by([("n_tokens", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "mark", "copy")]])
        sizes = rows["n_tokens"].to_numpy()
        bins, offsets, final = best_fit(sizes.tolist(), lengths)
        bins = np.array(bins)
        held = np.bincount(bins, weights=sizes, minlength=len(final)).astype(np.int64)
        first = int(rows["group"][0].as_py()) << 32
        found = (bins + first, np.array(offsets, np.int64), np.array(final, np.int64)[bins], held[bins])
        return pa.table(dict(zip(("doc_id", "piece", "start", "n_tokens", "bin_id", "offset", "capacity", "bin_tokens"), (
            *(rows[c] for c in ("doc_id", "piece", "start", "n_tokens")), *found))))

    ids = parts.schema["doc_id"].dataType.simpleString()
    return parts.withColumn("group", group).groupBy("group").applyInArrow(packed, f"doc_id {ids}, {PLACED}")
