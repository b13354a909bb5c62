"""Turn repair against a best-first search over all edit sequences, and cuts into blocks of any size."""

import hashlib
import heapq
import random
import re

import pytest

from ledgerlens.llm import repair

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault), by trying sequences from the cheapest on."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, k, initials, lines = heapq.heappop(heap)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, lines
        if (k, initials[-1:], len(initials) > 0, cost, audit) in done or len(initials) > 2 * len(rows) + 3:
            continue
        done.add((k, initials[-1:], len(initials) > 0, cost, audit))

        def step(more, letter, consumed, role=None, text=""):
            new = initials + (role[:1] if role else "")
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + letter, k + consumed, new, (*lines, f"{role}:{text}") if role else lines))

        for role in ("user", "assistant"):
            step(2, "I", 0, role)
        if k < len(rows):
            role, text, fault = rows[k]
            step(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if role:
                    step(cut, "K", 1, role, text)
                for new in ("user", "assistant"):
                    step(2 + cut, "R", 1, new, text)


def brute(rows):
    """Facts of one conversation from its rows (turn, role, text)."""
    rows = sorted(((t is not None, t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))
    seen, marked, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, _, role, text in rows:
        said = text.strip(BLANK)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
        if fault:
            counts[fault] += 1
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[1] for r in rows if r[0]]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = cheapest(marked)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def results(frame):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    found = {}
    for r in frame.collect():
        assert r["conv_id"] not in found
        found[r["conv_id"]] = tuple(r[c] for c in columns)
    return found


def random_rows(rng, conversations, most):
    rows = []
    for c in range(conversations):
        turn = rng.choice([0, 5, -3])
        for _ in range(rng.randint(0, most)):
            turn += rng.choice([0, 1, 1, 1, 4])
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Yes.", "No", "", " \n", "Why? ", "é!", None, "A. b"])))
    return rows


@pytest.mark.parametrize("block_rows", [1, 2, 512])
def test_cheapest_repair(spark, block_rows):
    rng = random.Random(block_rows)
    rows = random_rows(rng, 120, 6)
    frame = spark.createDataFrame(rows + rows[:20], SCHEMA)
    found = results(repair.report(repair.repair(frame.repartition(5), block_rows=block_rows)))
    by_id = {}
    for c, *row in rows + rows[:20]:
        by_id.setdefault(c, []).append(tuple(row))
    assert found == {c: brute(rows) for c, rows in by_id.items()}


def test_one_long_conversation_over_many_tasks(spark):
    """A conversation with most rows, cut at different places, gives one result; so do its pieces' turns."""
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", f"n {t}", "", f"q{t}?"])) for t in range(3000)]
    rows += [(2, 0, "user", "Hi."), (None, 0, "assistant", "Hi.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = []
    for block_rows, parts in ((5000, 1), (64, 4), (7, 9)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            pieces = repair.repair(frame, block_rows=block_rows)
            found.append(results(repair.report(pieces)))
            turns = [(t["role"], t["text"]) for r in pieces.where("conv_id = 1").orderBy("piece").collect() for t in r["turns"]]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        initials = "".join(r[:1] for r, _ in turns)
        assert re.fullmatch("(s?(ua)+)?", initials)
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == found[-1][1][-1]
    assert found[0] == found[1] == found[2]
    assert found[0][2] == (0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())
    assert found[0][None][5:7] == (2, "IK")


def test_defined_cases(spark):
    big = 2**53 + 1
    rows = [(1, None, None, None), (2, big, "user", "A."), (2, None, "system", "S."), (3, 0, "user", "x" * 300_000 + "."),
            (3, 1, "assistant", "B."), (3, 1, "assistant", "B.")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS cost", "1 AS piece")
    found = results(repair.report(repair.repair(frame, block_chars=1000)))
    empty = hashlib.sha256(b"").hexdigest()
    assert found[1] == (0, 1, 0, 0, 0, 3, "D", empty)
    assert found[2] == brute([(big, "user", "A."), (None, "system", "S.")])
    assert found[3][1:7] == (0, 1, 0, 1, 3, "KKD")
    assert repair.report(repair.repair(frame.limit(0))).count() == 0


def test_rows_of_dropped_conversations_stay(spark):
    frame = spark.createDataFrame([(1, 0, "user", "A.", 0), (2, 0, "user", "A.", 2)], SCHEMA + ", copies int")
    found = results(repair.report(repair.repair(frame)))
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[2] == brute([(0, "user", "A."), (0, "user", "A.")])


def test_many_equal_rows_of_one_turn(spark):
    frame = spark.range(4000).selectExpr("1L AS conv_id", "0L AS turn", "'user' AS role", "'Hi.' AS text")
    found = results(repair.report(repair.repair(frame, block_rows=100)))[1]
    assert found[1:6] == (0, 3999, 0, 3999, 3999 * 3 + 2)
    assert len(found[6]) == 4001
