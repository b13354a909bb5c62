"""Repair of the turn structure of conversations by the cheapest edits.

A repaired conversation is empty or an optional system turn followed by pairs of user and assistant turns. Editing is a path
through a graph whose nodes are (rows consumed, role state) and whose edges are Keep, Rerole, Delete and Insert. The weight
of a path is one big integer: the high digits carry the cost, and the digit of fixed width at the place of each edit carries
its letter, zeros filling the end. The least integer is then the cheapest repair, and among equals the one whose audit (the
letters in order) comes first; a plain minimum over integers decides both.

Conversations of any length: rows are range-partitioned by conversation, turn, role and text, so one conversation may span
many tasks, and each task walks its sorted rows and cuts them into blocks of at most `block_rows` rows or `block_chars`
characters. An edit that inserts belongs to the block of the row it precedes. Two paths through a block then consume the same
rows and end with an edit of a row, so neither audit is a beginning of the other: the least path between each pair of states
is the same whatever follows. A conversation that lies within one block is repaired where it is met; for the others only 32
small numbers a block (cost and order of the paths between states) meet by conversation, and the chosen paths go back to the
blocks. No task holds a conversation's texts.

Defined cases: null roles and texts count as one space; a row without any character but blanks is blank; rows of one turn are
ordered by role and text, null turns first; equal rows are combined before they are shuffled; a role with no initial (empty)
can't be kept; a null conversation id is a conversation; extra columns are ignored; an empty table gives no rows. A row with
`copies` 0 stands for none but keeps its conversation in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerlens.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
#: letters of the audit by their code; a higher code is a later letter of the alphabet, 0 is padding
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
DIGIT = 3
#: states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ROLE_AFTER = {USER: "user", ASSISTANT: "assistant"}


def _next_turn(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _row_edits(code: str, state: int) -> list[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits of one row. Codes: `x` must go; else the role's initial (`o`: another), upper case if truncated."""
    out = [(DELETE, COST[DELETE], state)]
    if code == "x":
        return out
    extra, role, wanted = int(code.isupper()), code.lower(), _next_turn(state)
    if role == "s" and state == START:
        out.append((KEEP, extra, SYSTEM))
    if role == "ua"[wanted == ASSISTANT]:
        out.append((KEEP, extra, wanted))
    out.append((REROLE, COST[REROLE] + extra, wanted))
    return out


def _least_paths(codes: str, entry: int) -> tuple[dict[int, tuple[int, int]], int]:
    """State after the last row -> (least path integer, letters in it), and the width in digits.

    A path has at most two inserts before a row: a third would lead where the first did.
    """
    width = 3 * len(codes) + 2
    unit = 1 << (DIGIT * width)
    best = {entry: (0, 0)}
    for code in codes:
        reached: dict[int, tuple[int, int]] = {}
        for state, (value, n) in best.items():
            for inserts in range(3):
                if inserts:
                    value += COST[INSERT] * unit + (INSERT << (DIGIT * (width - 1 - n)))
                    state, n = _next_turn(state), n + 1
                for letter, cost, after in _row_edits(code, state):
                    total = value + cost * unit + (letter << (DIGIT * (width - 1 - n)))
                    if after not in reached or total < reached[after][0]:
                        reached[after] = total, n + 1
        best = reached
    return best, width


def _read(value: int, n: int, width: int) -> tuple[int, str]:
    """Cost and letters of a path integer."""
    letters = "".join(LETTERS[(value >> (DIGIT * (width - 1 - k))) & 7] for k in range(n))
    return value >> (DIGIT * width), letters


@lru_cache(maxsize=50_000)
def whole_repair(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation that lies in one block."""
    ends, (best, width) = [], _least_paths(codes, START)
    unit = 1 << (DIGIT * width)
    for state, (value, n) in best.items():
        for _ in range(TAIL[state]):
            value, n = value + COST[INSERT] * unit + (INSERT << (DIGIT * (width - 1 - n))), n + 1
        ends.append((value, n))
    return _read(*min(ends), width)


@lru_cache(maxsize=5_000)
def block_paths(codes: str) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, letters) of the least paths through a block."""
    out = []
    for entry in range(4):
        best, width = _least_paths(codes, entry)
        out += [(entry, state, *_read(value, n, width)) for state, (value, n) in sorted(best.items())]
    return tuple(out)


def apply_edits(audit: str, roles: list[str], texts: list[str], state: int) -> list[dict]:
    """Repaired turns of the rows that the letters consume, from a role state on."""
    out, k = [], 0
    for letter in audit:
        if letter == "D":
            k += 1
            continue
        state = SYSTEM if letter == "K" and roles[k][:1] == "s" else _next_turn(state)
        if letter == "I":
            out.append({"role": ROLE_AFTER[state], "text": ""})
            continue
        out.append({"role": roles[k] if letter == "K" else ROLE_AFTER[state], "text": texts[k]})
        k += 1
    return out


PIECE = ("blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, turns_seen long, "
         "first_turn long, last_turn long, head string, tail string, part int, seq int, whole boolean, cost long, audit string, "
         "turns array<struct<role:string,text:string>>, codes string, roles array<string>, texts array<string>, "
         "costs array<int>, ranks array<int>")
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Block:
    """Rows of one conversation that a task has met one after another."""

    def __init__(self, conv, seq: int):
        self.conv, self.seq = conv, seq
        self.codes: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.chars = 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.least = self.most = self.first_turn = self.last_turn = self.head = None
        self.tail = None
        self.turns_seen = 0

    def add(self, turn, role: str, text: str, seen: bool, previous: _Block | None) -> None:
        """One row; `previous` is the block before in this task, whose last row precedes the first of this one."""
        before = self if self.codes else previous
        if before is None:
            self.head, self.first_turn = role[:1], turn
        elif before.tail + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        if turn is not None and (before is None or turn != before.last_turn):
            self.turns_seen += 1
        if turn is not None:
            self.least = turn if self.least is None else min(self.least, turn)
            self.most = turn if self.most is None else max(self.most, turn)
        said = text.rstrip(BLANKS)
        fault = "blank" if not said else "duplicate" if seen else "truncated" if said[-1] not in ENDS else None
        if fault:
            self.counts[fault] += 1
        gone = fault in ("blank", "duplicate")
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        self.codes.append("x" if gone else initial.upper() if fault else initial)
        self.roles.append(role)
        self.texts.append("" if gone else text)
        self.chars += 0 if gone else len(text)
        self.tail, self.last_turn = role[:1], turn

    def record(self, part: int, whole: bool) -> dict:
        codes = "".join(self.codes)
        out = self.counts | {
            "conv_id": self.conv, "least_turn": self.least, "most_turn": self.most, "turns_seen": self.turns_seen,
            "first_turn": self.first_turn, "last_turn": self.last_turn, "head": self.head, "tail": self.tail,
            "part": part, "seq": self.seq, "whole": whole}
        if whole:
            cost, audit = whole_repair(codes)
            return out | {"cost": cost, "audit": audit, "turns": apply_edits(audit, self.roles, self.texts, START)}
        costs, ranks, paths = [-1] * 16, [-1] * 16, block_paths(codes)
        for entry in range(4):
            mine = sorted((letters, state, cost) for e, state, cost, letters in paths if e == entry)
            for rank, (_, state, cost) in enumerate(mine):
                costs[4 * entry + state], ranks[4 * entry + state] = cost, rank
        return out | {"codes": codes, "roles": self.roles, "texts": self.texts, "costs": costs, "ranks": ranks}


def _walk(ids: pa.DataType, block_rows: int, block_chars: int):
    """Function over the sorted rows of a task: whole conversations repaired, blocks of those that may go on elsewhere."""
    schema = pa.schema([("conv_id", ids)] + [
        (c, pa.int64()) for c in (*COUNTS, "least_turn", "most_turn", "turns_seen", "first_turn", "last_turn")] + [
        ("head", pa.string()), ("tail", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()),
        ("cost", pa.int64()), ("audit", pa.string()), ("turns", TURNS), ("codes", pa.string()),
        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
        ("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32()))])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        block, previous, begun, edge = None, None, False, True
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "seen")]
            for conv, turn, role, text, copies, seen in zip(*columns):
                if not begun or conv != block.conv:
                    if begun:
                        # the first conversation of a task may have begun in the task before
                        yield block.record(part, whole=not edge and previous is None)
                        edge = False
                    block, previous, begun = _Block(conv, 0), None, True
                for k in range(copies):
                    if block.codes and (len(block.codes) >= block_rows or block.chars + len(text) > block_chars):
                        yield block.record(part, whole=False)
                        block, previous = _Block(conv, block.seq + 1), block
                    block.add(turn, role, text, seen or k > 0, previous)
        if begun:
            yield block.record(part, whole=False)  # the last one may go on in the next task

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for r in records(batches):
            held.append(r)
            weight += 200 + sum(map(len, r.get("texts") or ())) + sum(len(t["text"]) for t in r.get("turns") or ())
            if weight > 1 << 22:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return walk


def _choose(blocks: pd.DataFrame) -> pd.DataFrame:
    """Least way through the blocks of one conversation: states before and after each, totals on every line."""
    blocks = blocks.sort_values(["part", "seq"]).reset_index(drop=True)
    best, back = {START: (0, 0)}, []
    for costs, ranks in zip(blocks["costs"], blocks["ranks"]):
        found, came = {}, {}
        for state, (cost, rank) in best.items():
            for after in range(4):
                step = 4 * state + after
                # audits of different states differ before this block, so their order there comes first
                if costs[step] >= 0 and (after not in found or (cost + costs[step], rank, ranks[step]) < found[after]):
                    found[after], came[after] = (cost + costs[step], rank, ranks[step]), state
        order = {key: k for k, key in enumerate(sorted({v[1:] for v in found.values()}))}
        best = {s: (v[0], order[v[1:]]) for s, v in found.items()}
        back.append(came)
    end = min(best, key=lambda s: (best[s][0] + COST[INSERT] * TAIL[s], best[s][1]))
    out = blocks[["conv_id", "part", "seq"]].copy()
    states = [end]
    for came in reversed(back):
        states.append(came[states[-1]])
    states.reverse()
    out["entry"], out["exit"] = states[:-1], states[1:]
    out["piece"], out["pieces"] = range(len(out)), len(out)
    out["inserts"] = [0] * (len(out) - 1) + [TAIL[end]]
    out["cost"] = best[end][0] + COST[INSERT] * TAIL[end]
    for c in COUNTS[:3]:
        out[c] = int(blocks[c].sum())
    illegal, seen, last = int(blocks["illegal"].sum()), int(blocks["turns_seen"].sum()), None
    for head, first, tail, turn in zip(blocks["head"], blocks["first_turn"], blocks["tail"], blocks["last_turn"]):
        if tail is None:
            continue
        if last is not None and head is not None:  # first block of another task
            illegal += last[0] + head not in LEGAL
            seen -= first is not None and first == last[1]
        last = tail, turn
    out["illegal"] = illegal
    turns = [int(t) for t in (*blocks["least_turn"], *blocks["most_turn"]) if t is not None]
    out["gaps"] = max(turns) - min(turns) + 1 - seen if seen else 0
    return out


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen path of each block as letters and repaired turns."""
    for batch in batches:
        audits, turns = [], []
        for r in batch.select(["codes", "roles", "texts", "entry", "exit", "inserts"]).to_pylist():
            paths = {(a, b): letters for a, b, _, letters in block_paths(r["codes"])}
            audit = paths[r["entry"], r["exit"]] + "I" * r["inserts"]
            audits.append(audit)
            turns.append(apply_edits(audit, r["roles"], r["texts"], r["entry"]))
        kept = ["conv_id", "piece", "pieces", *COUNTS, "gaps", "cost"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept] + [pa.array(audits, pa.string()), pa.array(turns, TURNS)], names=[*kept, "audit", "turns"])


def repair(rows: DataFrame, block_rows: int = 512, block_chars: int = 1 << 20) -> DataFrame:
    """Repaired conversations in pieces of bounded size, nearly always one each.

    `rows` has conv_id, turn, role, text and, if wished, copies. Columns: conv_id, piece (from 0), pieces, the faults and
    cost of the whole conversation (blank, duplicate, truncated, illegal, gaps, cost), and the audit and turns of the piece.
    """
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.alias("copies"))
    # equal rows are one line with a number from here on
    grouped = cut_lineage(plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "repair-rows")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    several = (
        grouped.where("copies > 0").select("conv_id", "role", digest.alias("digest"), at.alias("at"))
        .groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    marked = grouped.withColumn("d0", digest).join(
        several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("d0") == F.col("d")), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "copies", F.coalesce(F.col("first") < at, F.lit(False)).alias("seen"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    ids = rows.schema["conv_id"].dataType
    sorted_rows = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = cut_lineage(sorted_rows.mapInArrow(
        _walk(to_arrow_type(ids), block_rows, block_chars), f"conv_id {ids.simpleString()}, {PIECE}"), "repair-blocks")
    gaps = F.when(F.col("turns_seen") > 0, F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns_seen")).otherwise(F.lit(0).cast("long"))
    columns = ["conv_id", "piece", "pieces", *COUNTS, "gaps", "cost", "audit", "turns"]
    whole = walked.where("whole").select(
        "conv_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), *COUNTS, gaps.alias("gaps"), "cost", "audit", "turns")
    parts = walked.where(~F.col("whole"))
    # turns as text: pandas would turn longs beside nulls into doubles
    narrow = parts.select("conv_id", "part", "seq", *COUNTS, "turns_seen", "head", "tail", "costs", "ranks", *[
        F.col(c).cast("string").alias(c) for c in ("least_turn", "most_turn", "first_turn", "last_turn")])
    kept = ("part int, seq int, entry int, exit int, piece int, pieces int, inserts int, cost long, "
            "blank long, duplicate long, truncated long, illegal long, gaps long")
    chosen = narrow.groupBy("conv_id").applyInPandas(_choose, f"conv_id {ids.simpleString()}, {kept}")
    chosen = chosen.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p").withColumnRenamed("seq", "q")
    blocks = parts.select("conv_id", "part", "seq", "codes", "roles", "texts").join(
        chosen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q")))
    schema = (f"conv_id {ids.simpleString()}, piece int, pieces int, blank long, duplicate long, truncated long, illegal long, "
              "gaps long, cost long, audit string, turns array<struct<role:string,text:string>>")
    rendered = blocks.select("conv_id", "piece", "pieces", *COUNTS, "gaps", "cost", "codes", "roles", "texts", "entry", "exit",
                             "inserts").mapInArrow(_render, schema)
    return whole.select(columns).unionByName(rendered)


def report(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: faults, cost, audit and the SHA-256 of `role:text` of its repaired turns, a line each."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    facts = ["conv_id", "gaps", *COUNTS, "cost"]
    one = pieces.where("pieces = 1").select(*facts, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    ids = pieces.schema["conv_id"].dataType.simpleString()
    many = (
        pieces.where("pieces > 1").select(*facts, "audit", "piece", "pieces", F.size("turns").alias("n"), lines.alias("lines"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "piece")
        .mapInArrow(_join_pieces, f"conv_id {ids}, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                  "cost long, audit string, repaired_sha256 string"))
    return one.unionByName(many)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, one conversation after another: letters are joined, texts only pass through the digest."""
    facts = ["conv_id", "gaps", *COUNTS, "cost"]
    audit, digest, begun = [], hashlib.sha256(), False
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            r = row.select(["audit", "piece", "pieces", "n", "lines"]).to_pylist()[0]
            audit.append(r["audit"])
            if r["n"]:
                digest.update((b"\n" if begun else b"") + r["lines"].encode())
                begun = True
            if r["piece"] == r["pieces"] - 1:
                yield pa.RecordBatch.from_arrays(
                    [row.column(c) for c in facts] + [pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
                    names=[*facts, "audit", "repaired_sha256"])
                audit, digest, begun = [], hashlib.sha256(), False


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that a checksum of `conv_id:turn` plants; a dropped row stays with no copies."""
    def spaced(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")), F.lit(20))
    text = F.when(fault.isin(0, 1), F.lit("")).when(fault == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
