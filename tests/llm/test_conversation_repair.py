"""Repair against all sequences of edits, and the query against SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb

from panelspark.llm import conversation_repair, queries
from tests.test_entry import rows_of

SMALL = "/root/testdata/sf0.001"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{conv if conv is not None else ' '}:{turn if turn is not None else ' '}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """The cheapest edits of all there are: (cost, audit, repaired text)."""
    best = None

    def go(at, cost, audit, turns):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
            new = (cost, audit, "\n".join(f"{r}:{t}" for r, t in turns))
            best = new if best is None else min(best, new)
        if not audit.endswith("III") and audit.count("I") < 4:
            for role in ("user", "assistant"):
                go(at, cost + 5, audit + "I", [*turns, (role, "")])
        if at < len(rows):
            role, text = rows[at]
            go(at + 1, cost + 2, audit + "D", turns)
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                go(at + 1, cost + more, audit + "K", [*turns, (role, text)])
                for other in ("user", "assistant"):
                    go(at + 1, cost + 1 + more, audit + "R", [*turns, (other, text)])

    go(0, 0, "", [])
    return best


def plain_report(rows):
    out = {}
    damaged = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, pairs, faults = [r[1] for r in own if r[1] is not None], [(r[2], r[3]) for r in own], []
        for at, (role, text) in enumerate(pairs):
            bare = text.rstrip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in pairs[:at] else "truncated" if bare[-1] not in ".!?" else None)
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, text = cheapest(pairs, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(spark, rows, **more):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS place", "'x' AS audit")
    got = conversation_repair.repair_report(frame, **more).collect()
    out = {r.conv_id: tuple(r[c] for c in COUNTS) for r in got}
    assert len(out) == len(got)
    return out


def conversations(seed, count, longest):
    rng, rows = random.Random(seed), []
    for conv in range(count):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", " \t\n", "", None, "Yes.", "Fine. \n", "a.b"])
            rows.append((conv if conv else None, turn if rng.random() > 0.05 else None, role, text))
    return rows


def test_equals_all_edits(spark):
    rows = conversations(3, 150, 5)
    assert found(spark, rows) == plain_report(rows)


def test_blocks_change_nothing(spark):
    rows = conversations(4, 40, 30)
    whole = found(spark, rows)
    assert found(spark, rows, block=1) == whole
    assert found(spark, rows, block=7) == whole


def test_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 7 else "cut") for t in range(20_000)]
    (got,) = found(spark, rows).values()
    kinds = [zlib.crc32(f"1:{t}".encode()) % 20 for t in range(20_000)]
    assert got[0] == sum(k == 0 for k in kinds[1:-1])
    assert len(got[6].replace("I", "")) == sum(1 + (k == 3) - (k == 0) for k in kinds)


def test_nothing_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert found(spark, []) == {}


def test_query_equals_oracle(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    own, wanted = queries.op11_conversation_repair(spark, SMALL), db.execute(conversation_repair.oracle())
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(own.columns)
    assert rows_of(own.columns, own.collect()) == rows_of(names, wanted.fetchall())


def test_oracle_on_odd_rows(spark):
    import pyarrow as pa

    rows = conversations(9, 200, 9)
    db = duckdb.connect()
    db.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows], schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
    wanted = db.execute(f"SELECT conv_id, {', '.join(COUNTS)} FROM ({conversation_repair.oracle()})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in wanted} == found(spark, rows)
