"""Conversation structure repair by Hirschberg's divide and conquer over a four-state cost vector.

A conversation is a row of turns; the repaired roles must read ``(s?(ua)+)?`` in initials. States: 0 nothing yet, 1 after the
system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end. Every turn is kept (0), given the role that the
state asks for (2) or deleted (3, the only choice for blank and duplicate turns); empty turns may be inserted anywhere (2); a
turn that stays although truncated costs 1. Among cheapest edits the audit string least in ASCII counts.

Forward vectors hold the least cost of every state and the order of the least audits that reach it (two audits of one
position never are prefixes of each other, so an order among the four states is enough); backward vectors hold the cost to
the end. Halves meet at the middle: among crossings whose costs add up to the optimum the one first in the order is taken,
and both halves recurse. So no table of all positions is kept. Vectors, less their minimum, take few values: steps between
them are remembered per kind of turn.

A conversation of at most ``block`` turns is one block. A longer one, of any length, is cut into blocks of a sorted table:
tasks turn each block into its forward step from every state and its backward step to every state, one short pass over the
blocks of a conversation fixes the crossings between blocks by the same rule, then blocks are repaired on their own. Only the
digest of the repaired text, which SHA-256 defines as one chain, reads a long conversation in order in one task, as a
stream of rows.

Defined cases
* null role or text: one space (so a blank turn, or a role no rule knows); a null turn sorts first and is left out of ``gaps``;
  a null ``conv_id`` is a conversation of its own. Equal turns are read by role, then text.
* a role whose first letter is s, u or a may be kept as it is; any other, and an empty one, cannot be kept.
* an empty table gives no rows; a conversation that lost every turn gives zeros, an empty audit and the digest of no text.
* other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import written

WHITE = "\t\n\x0b\x0c\r "
STOPS = ".!?"
INF = 1 << 40
SYSTEM, USER, ASSISTANT, OTHER = 0, 1, 2, 3
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
GONE = 8  # kind of a turn that must go; the others are 2 * initial + truncated
KEEP_TO = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (3, USER): 2, (2, ASSISTANT): 3}
WANTED = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after an inserted or re-roled turn
ROLE_OF = {2: "user", 3: "assistant"}
TAIL = (("", 0), ("II", 4), ("I", 2), ("", 0))  # inserts that end a conversation, and their cost


def edges() -> dict[int, list[list[tuple[str, int, int]]]]:
    """Per kind and state the ways over one turn: (audit, cost, state after), inserts before the edit included."""
    out = {}
    for kind in range(GONE + 1):
        per_state = []
        for start in range(4):
            ways, state, lead, cost = [], start, "", 0
            for _ in range(3):  # more than two inserts come back to a state already left
                ways.append((lead + "D", cost + 3, state))
                if kind != GONE:
                    late = kind & 1
                    kept = KEEP_TO.get((state, kind >> 1))
                    if kept is not None:
                        ways.append((lead + "K", cost + late, kept))
                    ways.append((lead + "R", cost + 2 + late, WANTED[state]))
                lead, cost, state = lead + "I", cost + 2, WANTED[state]
            per_state.append(ways)
        out[kind] = per_state
    return out


WAYS = edges()


class Steps:
    """Forward and backward steps between normalised vectors, remembered per kind of turn."""

    def __init__(self):
        self.ahead: dict = {}
        self.back: dict = {}

    def forward(self, vector, kind):
        """vector: (costs, places) per state; returns the next vector and the cost taken out of it."""
        got = self.ahead.get((vector, kind))
        if got is None:
            costs, places = vector
            best = {}
            for s in range(4):
                if costs[s] < INF:
                    for audit, cost, t in WAYS[kind][s]:
                        new = (costs[s] + cost, places[s], audit)
                        if t not in best or new < best[t]:
                            best[t] = new
            order = sorted(best, key=lambda t: best[t][1:])
            low = min(b[0] for b in best.values())
            got = self.ahead[(vector, kind)] = (
                (tuple(best[t][0] - low if t in best else INF for t in range(4)), tuple(order.index(t) if t in best else 4 for t in range(4))),
                low,
            )
        return got

    def backward(self, costs, kind):
        got = self.back.get((costs, kind))
        if got is None:
            new = [min((cost + costs[t] for _, cost, t in WAYS[kind][s] if costs[t] < INF), default=INF) for s in range(4)]
            low = min(new)
            got = self.back[(costs, kind)] = (tuple(c - low if c < INF else INF for c in new), low)
        return got


STEPS = Steps()


def only(state: int) -> tuple:
    return tuple(0 if s == state else INF for s in range(4))


def run_forward(kinds, a: int, b: int, vector):
    total = 0
    for i in range(a, b):
        vector, low = STEPS.forward(vector, kinds[i])
        total += low
    return vector, total


def run_backward(kinds, a: int, b: int, costs):
    total = 0
    for i in range(b - 1, a - 1, -1):
        costs, low = STEPS.backward(costs, kinds[i])
        total += low
    return costs, total


def crossing(forward, back) -> int:
    """The state at which the halves meet: least sum of costs, then first in the order of the forward audits."""
    costs, places = forward
    return min((costs[s] + back[s], places[s], s) for s in range(4) if costs[s] < INF and back[s] < INF)[2]


def repair(kinds, a: int, b: int, start: int, end: int, out: list[str]) -> None:
    """Append the edits of turns a to b (inserts before a turn with it) of the least audit from one state to another."""
    work = [(a, b, start, end)]
    while work:
        a, b, start, end = work.pop()
        if b - a == 1:
            out.append(min((cost, audit) for audit, cost, t in WAYS[kinds[a]][start] if t == end)[1])
            continue
        mid = (a + b) // 2
        ahead, _ = run_forward(kinds, a, mid, (only(start), tuple(0 if s == start else 4 for s in range(4))))
        back, _ = run_backward(kinds, mid, b, only(end))
        meet = crossing(ahead, back)
        work += [(mid, b, meet, end), (a, mid, start, meet)]


def cheapest(kinds) -> tuple[int, int]:
    """Cost of the cheapest edits of a whole conversation and the state after its last turn."""
    ahead, total = run_forward(kinds, 0, len(kinds), (only(0), (0, 4, 4, 4)))
    end = crossing(ahead, tuple(cost for _, cost in TAIL))
    return total + ahead[0][end] + TAIL[end][1], end


def edits(kinds) -> tuple[int, list[str], int]:
    """Cost, edit strings per turn, last state."""
    if not len(kinds):
        return 0, [], 0
    cost, end = cheapest(kinds)
    out: list[str] = []
    repair(kinds, 0, len(kinds), 0, end, out)
    return cost, out, end


def repaired_lines(edit: str, state: int, role: str, text: str) -> tuple[list[str], int]:
    """Lines ``role:text`` that one turn leaves, and the state after it."""
    lines = []
    for c in edit:
        if c == "I":
            state = WANTED[state]
            lines.append(f"{ROLE_OF[state]}:")
        elif c == "R":
            state = WANTED[state]
            lines.append(f"{ROLE_OF[state]}:{text}")
        elif c == "K":
            state = KEEP_TO[(state, INITIAL[role[0]])]
            lines.append(f"{role}:{text}")
    return lines, state


def tail_lines(state: int) -> list[str]:
    return ["user:", "assistant:"] if state == 1 else ["assistant:"] if state == 2 else []


def broken_off(text: str) -> bool:
    return text.rstrip(WHITE)[-1:] not in STOPS


# --- Spark side -----------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the seeded damage: conv_id, turn, role, text; the bucket is crc32(conv_id:turn) % 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    bucket = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(bucket == 1, "").when(bucket == 2, F.translate(space("text"), STOPS, "")).otherwise(space("text"))
    role = F.when(bucket == 4, "user").otherwise(space("role"))
    copies = F.when(bucket == 0, 0).when(bucket == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.where("copies > 0").select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result_schema(rows: DataFrame) -> str:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def whole_conversation(turns: list, roles: list[str], texts: list[str]) -> tuple:
    kinds, seen, blank, again, late, illegal, before = bytearray(), set(), 0, 0, 0, 0, None
    for role, text in zip(roles, texts):
        if not text.strip(WHITE):
            kind, blank = GONE, blank + 1
        elif (role, text) in seen:
            kind, again = GONE, again + 1
        else:
            cut = broken_off(text)
            late += cut
            kind = 2 * INITIAL.get(role[:1], OTHER) + cut
        seen.add((role, text))
        kinds.append(kind)
        if before is not None and before + role[:1] not in ("su", "ua", "au"):
            illegal += 1
        before = role[:1]
    cost, steps, end = edits(kinds)
    lines, state = [], 0
    for edit, role, text in zip(steps, roles, texts):
        new, state = repaired_lines(edit, state, role, text)
        lines += new
    lines += tail_lines(end)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, blank, again, late, illegal, cost, "".join(steps) + TAIL[end][0], hashlib.sha256("\n".join(lines).encode()).hexdigest()


def repair_short(rows: DataFrame) -> DataFrame:
    """Conversations of bounded length: rows meet in order in one partition, each conversation is repaired as it passes."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", "text")
    fields = pa.schema([*pa_key(kind), *((c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, done = None, False, []
        turns, roles, texts = [], [], []
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and conv != now:
                    done.append((now, *whole_conversation(turns, roles, texts)))
                    turns, roles, texts = [], [], []
                now, open_ = conv, True
                turns.append(turn)
                roles.append(role)
                texts.append(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), fields)], schema=fields)
                done = []
        if open_:
            done.append((now, *whole_conversation(turns, roles, texts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), fields)], schema=fields)

    return ordered.mapInArrow(run, result_schema(rows))


def pa_key(kind: str) -> list[tuple[str, pa.DataType]]:
    return [("conv_id", {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind])]


def positions(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in a written table with their place (part, seq): parts are ranges of the sorted rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    salted = rows.withColumn("h", F.xxhash64("role", "text")).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", F.asc_nulls_first("turn"), "role"]
    ranged = salted.repartitionByRange(*order, "h", "salt").sortWithinPartitions(*order, "text", "salt").select("conv_id", "turn", "role", "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(seq, seq + n))], names=[*batch.schema.names, "part", "seq"])
            seq += n

    return written(ranged.mapInArrow(number, f"conv_id {kind}, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, part int, seq bigint"))


def kind_column(first: Column) -> Column:
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    late = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), GONE + 1).when(~first, GONE + 2).otherwise(2 * code + late.cast("int"))


def repair_long(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of any length in blocks of at most ``block`` turns (see the module's head)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = positions(rows)
    key = [F.col("conv_id"), F.col("role"), F.sha2("text", 256).alias("sha")]
    narrow = placed.select(*key, "part", "seq", kind_column(F.lit(True)).alias("kind"), F.substring("role", 1, 1).alias("initial"))
    firsts = narrow.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("part", "seq")).alias("p")).select("p.part", "p.seq", F.lit(True).alias("first"))
    marked = narrow.join(firsts, ["part", "seq"], "left")
    again = F.col("first").isNull() & (F.col("kind") < GONE)
    row = F.struct("seq", F.when(again, GONE + 2).otherwise(F.col("kind")).cast("int").alias("kind"), "initial")
    blocks = written(
        marked.groupBy("conv_id", "part", F.floor(F.col("seq") / block).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("r"))
        .select("conv_id", "part", "block", F.transform("r", lambda x: x["kind"]).alias("kinds"), F.transform("r", lambda x: x["initial"]).alias("initials"), F.col("r")[0]["seq"].alias("low"))
    )

    summary = pa.schema([*pa_key(kind), ("part", pa.int32()), ("block", pa.int64()), ("step", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.string()))])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, counts, ends = [], [], []
            for kinds, initials in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                plain = [min(k, GONE) for k in kinds]
                step = []
                for s in range(4):  # from state s: costs and order of the four states after the block
                    (costs, places), low = run_forward(plain, 0, len(plain), (only(s), tuple(0 if t == s else 4 for t in range(4))))
                    step += [c + low if c < INF else INF for c in costs] + list(places)
                steps.append(step)
                bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                counts.append([kinds.count(GONE + 1), kinds.count(GONE + 2), sum(k < GONE and k & 1 for k in kinds), bad])
                ends.append([initials[0], initials[-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(steps, summary.field(3).type), pa.array(counts, summary.field(4).type), pa.array(ends, summary.field(5).type)], schema=summary)

    steps = blocks.mapInArrow(summarise, f"conv_id {kind}, part int, block bigint, step array<bigint>, counts array<bigint>, ends array<string>")

    def meet(key, table):
        table = table.sort_by([("part", "ascending"), ("block", "ascending")])
        step = np.array(table.column("step").to_pylist(), dtype=np.int64).reshape(-1, 4, 2, 4)
        n = len(step)
        ahead = [(only(0), (0, 4, 4, 4))]
        for i in range(n):
            costs, places = ahead[-1]
            best = {}
            for s in range(4):
                for t in range(4):
                    if costs[s] < INF and step[i, s, 0, t] < INF:
                        new = (costs[s] + int(step[i, s, 0, t]), places[s], int(step[i, s, 1, t]))
                        if t not in best or new < best[t]:
                            best[t] = new
            order = sorted(best, key=lambda t: best[t][1:])
            ahead.append((tuple(best[t][0] if t in best else INF for t in range(4)), tuple(order.index(t) if t in best else 4 for t in range(4))))
        back = tuple(cost for _, cost in TAIL)
        ends, end = [0] * n, crossing(ahead[n], back)
        cost = ahead[n][0][end] + TAIL[end][1]
        last = end
        for i in range(n - 1, -1, -1):
            ends[i] = end
            end = crossing(ahead[i], tuple(int(step[i, s, 0, end]) for s in range(4)))
        starts = [0, *ends[:-1]]
        edge = table.column("ends").to_pylist()
        counts = np.array(table.column("counts").to_pylist(), dtype=np.int64).sum(axis=0)
        illegal = int(counts[3]) + sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(edge, edge[1:]))
        whole = [int(counts[0]), int(counts[1]), int(counts[2]), illegal, int(cost), last]
        return pa.Table.from_arrays([table.column("conv_id"), table.column("part"), table.column("block"), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array([whole] * n, pa.list_(pa.int64()))],
                                    names=["conv_id", "part", "block", "start", "end", "whole"])

    met = written(steps.groupBy("conv_id").applyInArrow(meet, f"conv_id {kind}, part int, block bigint, start int, end int, whole array<bigint>"))

    def repair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for kinds, start, end in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6))):
                out: list[str] = []
                repair([min(k, GONE) for k in kinds], 0, len(kinds), start, end, out)
                got.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, pa.list_(pa.string()))], names=["conv_id", "part", "block", "low", "edits"])

    same = F.expr("m.part = b.part AND m.block = b.block AND m.conv_id <=> b.conv_id")
    joined = blocks.alias("b").join(met.alias("m"), same).select("b.conv_id", "b.part", "b.block", "b.low", "b.kinds", "m.start", "m.end")
    edited = written(joined.mapInArrow(repair_blocks, f"conv_id {kind}, part int, block bigint, low bigint, edits array<string>"))
    audits = edited.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "block", F.array_join("edits", "").alias("a")))).alias("a"))
    each = edited.select("part", "low", F.posexplode("edits").alias("at", "edit")).select("part", (F.col("low") + F.col("at")).alias("seq"), "edit")
    lined = placed.join(each, ["part", "seq"]).select("conv_id", "part", "seq", "role", "text", "edit")
    ordered = lined.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, state, some, sha, done = None, False, 0, False, hashlib.sha256(), []

        def close():
            end = "\n".join(tail_lines(state))
            sha.update((("\n" if some else "") + end if end else "").encode())
            done.append((now, sha.hexdigest()))

        for batch in batches:
            for conv, _, _, role, text, edit in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and conv != now:
                    close()
                    state, some, sha = 0, False, hashlib.sha256()
                now, open_ = conv, True
                lines, state = repaired_lines(edit, state, role, text)
                if lines:
                    sha.update((("\n" if some else "") + "\n".join(lines)).encode())
                    some = True
        if open_:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa_key(kind)[0][1]), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])

    digests = ordered.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")
    whole = met.groupBy("conv_id").agg(F.any_value("whole").alias("w"))
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    tails = F.array(*(F.lit(t) for t, _ in TAIL))
    out = whole.alias("w").join(audits.alias("a"), F.expr("w.conv_id <=> a.conv_id")).join(digests.alias("d"), F.expr("w.conv_id <=> d.conv_id")).join(turns.alias("t"), F.expr("w.conv_id <=> t.conv_id"))
    text = F.concat(F.array_join(F.transform("a.a", lambda x: x["a"]), ""), F.element_at(tails, F.col("w.w")[5].cast("int") + 1))
    return out.select("w.conv_id", "t.gaps", *(F.col("w.w")[i].alias(c) for i, c in enumerate(RESULT[1:6])), text.alias("audit"), "d.repaired_sha256")


def repair_rows(rows: DataFrame, block: int = 1 << 16, block_bytes: int = 1 << 24) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation of ``rows`` (conv_id, turn, role, text without nulls but in turn).

    Conversations beyond ``block`` turns or ``block_bytes`` bytes of text go the way in blocks; the results are the same."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long_ids = written(sizes.where((F.col("n") > block) | (F.col("b") > block_bytes)).select("conv_id", F.lit(True).alias("long")))
    if long_ids.isEmpty():
        return repair_short(rows)
    same = rows["conv_id"].eqNullSafe(long_ids["conv_id"])
    short, long_ = rows.join(long_ids, same, "left_anti"), rows.join(long_ids, same, "left_semi")
    return repair_short(short).unionByName(repair_long(long_, block))


def repair_damaged(conversations: DataFrame, block: int = 1 << 16, block_bytes: int = 1 << 24) -> DataFrame:
    """One row per original conversation: repair of its damaged rows; conversations that lost every row are empty."""
    found = repair_rows(damaged(conversations), block, block_bytes)
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    empty = {c: F.lit("") if c == "audit" else F.lit(hashlib.sha256(b"").hexdigest()) if c == "repaired_sha256" else F.lit(0).cast("bigint") for c in RESULT}
    joined = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("id").alias("conv_id"), *(F.coalesce(F.col(c), empty[c]).alias(c) for c in RESULT))
