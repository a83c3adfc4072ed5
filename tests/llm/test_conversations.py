"""Conversation repair against a dynamic programme over whole audit strings, in one block and in many."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from corvida.llm import conversations as cv

WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, uid long, part string, kinds int"


def legal(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(body) >= 2 and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def brute_repair(rows):
    """rows: (role, text, must_go, late). Least (cost, audit) over all partial results, kept per (turn, initials' state)."""

    def step(state, c):
        return {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("e", "u"): "u", ("u", "a"): "e"}.get((state, c))

    now = {"0": (0, "", ())}

    def inserts(now):
        for _ in range(3):
            for state, (cost, audit, lines) in list(now.items()):
                for role in ("user", "assistant"):
                    t = step(state, role[0])
                    if t:
                        new = (cost + 2, audit + "I", (*lines, f"{role}:"))
                        if t not in now or new[:2] < now[t][:2]:
                            now[t] = new
        return now

    for role, text, must_go, late in rows:
        now, after = inserts(dict(now)), {}
        for state, (cost, audit, lines) in now.items():
            ways = [(state, 3, "D", ())]
            if not must_go:
                ways.append((step(state, role[:1]) if role else None, late, "K", (f"{role}:{text}",)))
                ways += [(step(state, r[0]), 2 + late, "R", (f"{r}:{text}",)) for r in ("user", "assistant")]
            for t, c, letter, line in ways:
                new = (cost + c, audit + letter, lines + line)
                if t and (t not in after or new[:2] < after[t][:2]):
                    after[t] = new
        now = after
    now = inserts(dict(now))
    return min(v for s, v in now.items() if s in ("0", "e"))


def brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[r[0]]
        conv, turn, role, text = (" " if v is None else v for v in r[:4])
        bucket = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if bucket == 0:
            continue
        if bucket == 1:
            text = ""
        if bucket == 2:
            text = "".join(c for c in text if c not in ".!?")
        if bucket == 4:
            role = "user"
        groups[r[0]] += [(r[1], role, text)] * (2 if bucket == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, count = set(), [], [0, 0, 0]
        for _, role, text in rows:
            fault = 0 if not text.strip(WS) else 1 if (role, text) in seen else 2 if text.strip(WS)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            kinds.append((role, text, fault in (0, 1), int(fault == 2)))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = brute_repair(kinds)
        assert legal("".join(line[:1] for line in lines))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(12)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "agent", "User"]
    texts = ["Yes.", "No!", "so it goes", "a? ", "", " \t", None, "x" * 40000 + ".", "ü 日本 🙂?", "one. two"]
    out = []
    for conv in range(220):
        n = rng.randint(1, 14)
        weights = [6, 6, 1, 3, 3, 1, 1, 1, 1, 1] if conv % 2 else [5, 5, 1, 0, 0, 0, 0, 0, 0, 0]
        for turn in range(n):
            t = rng.choice(texts) if rng.random() < 0.4 else f"{rng.randint(0, 99)} words {turn}."
            out.append((conv, turn * rng.choice([1, 1, 1, 2]), rng.choices(roles, weights)[0], t, 1, "p", 2))
    out += [(None, t, "user" if t % 2 == 0 else "assistant", f"{t}.", 1, "p", 2) for t in range(9)]
    out += [(500, None, rng.choice(["user", "assistant"]), f"{i % 4}.", 1, "p", 2) for i in range(9)]  # nulls, ties, copies
    out += [(501, 3, "user", "same.", 1, "p", 2)] * 5
    out += [(600, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["", f"{t} ok", f"{t}.", "again."]), 1, "p", 2) for t in range(700)]  # long
    return out


def collected(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in cv.RESULT) for r in rows}


def test_repair_equals_brute_force(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    want = brute(data)
    assert collected(cv.repair_damaged(df)) == want
    assert collected(cv.repair_damaged(df, block=16)) == want  # one long conversation in blocks, the rest whole
    assert collected(cv.repair_damaged(df, block=3)) == want  # most conversations in blocks
    assert sum(v[5] for v in want.values()) > 500 and any("I" in v[6] for v in want.values())


def test_empty_table_and_lost_conversations(spark, data):
    assert cv.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    lost = [(c, 0, "user", "a.", 1, "p", 2) for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = collected(cv.repair_damaged(spark.createDataFrame(lost, SCHEMA)))
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == 3


def test_every_short_sequence_of_kinds():
    kinds = list(range(9))
    for n in (1, 2, 3):
        for seq in itertools.product(kinds, repeat=n):
            rows = [("suax"[k >> 1] if k < 8 else "u", "t", k == 8, k & 1) for k in seq]
            cost, audit, _ = brute_repair(rows)
            got, steps, end = cv.edits(bytes(seq))
            assert (got, "".join(steps) + cv.TAIL[end][0]) == (cost, audit), seq


def test_hot_conversation_is_spread_over_partitions(spark):
    n = 30000
    rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id, '.') text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is far below the advised size
    try:
        placed = cv.positions(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 2
    assert placed.orderBy("part", "seq").select("turn").toPandas()["turn"].tolist() == list(range(n))
