"""Cheapest repair of the structure of logged conversations by a dynamic program with square-root checkpoints.

A repaired conversation has roles whose initials read ``(s?(ua)+)?``.  Four states read that pattern: nothing yet, after
the system turn, after a user turn, after an assistant turn.  Going backward, a vector holds what the rest costs from each
state; the vector before a turn follows from the one after it.  Vectors are stored only at checkpoints; going forward, one
block at a time is computed again and the ASCII-least tight edit is taken at each step.

There are two levels of checkpoints.  Turns are sorted into range slices, so a conversation of any length is spread over
tasks; what a conversation has in one slice is a block.  The backward map of a block is a 4 x 4 matrix of least sums, so
the vectors at the ends of all blocks come from one small row a block.  Inside a block of n turns vectors are kept at every
sqrt(n)-th turn.  Only one letter a turn takes part in this; texts move once, in order, past a running hash.

Edits: Keep 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant turn) 3; a truncated turn that
stays costs 3 more.  A blank turn has no character but white space, a duplicate has role and text of an earlier turn;
both must go.  A truncated turn ends in something else than ``.``, ``!`` or ``?``.  The first of these faults counts.

Defined cases: nulls in role and text read as one space, and so do null ids and turns where they are hashed; turns sort by
number (null first), then role, then MD5 of the text; equal rows are repeats, of which all but the first are duplicates; a
null ``conv_id`` is one conversation; a conversation without turns costs nothing and repairs to the empty text; an empty
table gives no rows.  A repaired conversation has one SHA-256, so its texts pass one task, as a stream.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from dealsight.functions.scale import join_on
from dealsight.llm.common import cut, map_batches

SPACE = "\t\n\x0b\x0c\r "
ORDER = ["_known", "turn", "role", "_md5"]
LEGAL = ("su", "ua", "au")
NEVER = math.inf
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}  # state -> initial -> state
FILL = {0: 2, 1: 2, 2: 3, 3: 2}  # state after an inserted or reroled turn
FILL_ROLE = {2: "user", 3: "assistant"}  # its role, by the state it leads to
Vector = tuple[float, float, float, float]


def closed(v: Vector) -> Vector:
    """The vector with inserted turns allowed."""
    two, three = min(v[2], 3 + v[3]), min(v[3], 3 + v[2])
    return min(v[0], 3 + two), min(v[1], 3 + two), two, three


END: Vector = closed((0, NEVER, NEVER, 0))


def back(v: Vector, code: str) -> Vector:
    """The vector before a turn, from the one after it.  ``code``: initial (capital: truncated), ``o`` for others."""
    initial, late = code.lower(), 3 if code.isupper() else 0
    best = []
    for s in range(4):
        c = min(4 + v[s], 3 + late + v[FILL[s]])
        if initial in STEP[s]:
            c = min(c, late + v[STEP[s][initial]])
        best.append(c)
    return closed(tuple(best))


def matrix(codes: str) -> list[float]:
    """Row s: least cost from state s before the block to each state after it."""
    columns = []
    for t in range(4):
        v = closed(tuple(0 if s == t else NEVER for s in range(4)))
        for code in reversed(codes):
            if code != "x":
                v = back(v, code)
        columns.append(v)
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(codes: str, copies: list[int], end: Vector, state: int, last: bool) -> tuple[str, int]:
    """Audit of a block and the state after it.  Vectors are kept at every sqrt(n)-th turn and made again between them."""
    n = len(codes)
    step = math.isqrt(n) + 1
    kept, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i == n - 1:
            kept[i + 1] = v
        if codes[i] != "x":
            v = back(v, codes[i])
    audit = []
    for start in range(0, n, step):
        stop = min(start + step, n)
        inside = [kept[stop]]
        for i in range(stop - 1, start - 1, -1):
            inside.append(inside[-1] if codes[i] == "x" else back(inside[-1], codes[i]))
        inside.reverse()
        for i in range(start, stop):
            code, m = codes[i], copies[i]
            if code == "x":  # deleting at once is always among the cheapest
                audit.append("D" * m)
                continue
            now, after = inside[i - start], inside[i - start + 1]
            initial, late = code.lower(), 3 if code.isupper() else 0
            while now[state] != 4 + after[state] and now[state] == 3 + now[FILL[state]]:
                audit.append("I")
                state = FILL[state]
            if now[state] == 4 + after[state]:
                audit.append("D")
            elif initial in STEP[state] and now[state] == late + after[STEP[state][initial]]:
                audit.append("K")
                state = STEP[state][initial]
            else:
                audit.append("R")
                state = FILL[state]
            audit.append("D" * (m - 1))
    while last and state in (1, 2):
        audit.append("I")
        state = FILL[state]
    return "".join(audit), state


def damage(turns: DataFrame) -> DataFrame:
    """Seeded damage: drops, empties, strips of end marks, repeats or turns to the user role, a twentieth of the turns each."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("_kind <> 0").select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                                           text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))


def keyed(turns: DataFrame) -> DataFrame:
    """Turns with their sort key: whether the number is known, the number, role and MD5 of the text."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("_turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"))
    return rows.select("conv_id", F.col("_turn").isNotNull().alias("_known"), F.coalesce("_turn", F.lit(0)).alias("turn"),
                       "role", F.md5("text").alias("_md5"), "text", "copies")


def faults(turns: DataFrame) -> DataFrame:
    """One row for each distinct (conversation, turn, role, text): ``fault`` of its first copy, ``copies`` and ``code``.

    ``code`` is ``x`` for a turn that must go, else the role's initial, ``o`` for none of s, u and a, capital if truncated.
    """
    rows = keyed(turns)
    trimmed = F.rtrim("text", F.lit(SPACE))
    rows = rows.select("conv_id", *ORDER, "copies", (trimmed == "").alias("_blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("_open"))
    light = rows.groupBy("conv_id", *ORDER).agg(F.sum("copies").alias("copies"), F.first("_blank").alias("_blank"), F.first("_open").alias("_open"))
    first = light.groupBy("conv_id", "role", "_md5").agg(F.min(F.struct("_known", "turn")).alias("_first"))
    light = join_on(light, first, ["conv_id", "role", "_md5"])
    again = F.struct("_known", "turn") != F.col("_first")
    fault = F.when(F.col("_blank"), "blank").when(again, "duplicate").when(F.col("_open"), "truncated")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    light = light.withColumn("fault", fault).withColumn("_initial", initial)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    return light.withColumn("code", code).select("conv_id", *ORDER, "copies", "fault", "_initial", "code")


def blocks(light: DataFrame) -> DataFrame:
    """One row for each conversation and range slice: its turns in order, as letters and copies."""
    n = int(light.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = light.repartitionByRange(n, "conv_id", *ORDER).withColumn("_slice", F.spark_partition_id())
    turn = F.struct(*ORDER, "copies", "fault", "_initial", "code")
    held = cut(placed.groupBy("conv_id", "_slice").agg(F.array_sort(F.collect_list(turn)).alias("_t")))
    own = F.aggregate(F.transform("_t", lambda t: F.when(t["fault"] == "blank", t["copies"]).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    twice = F.aggregate(F.transform("_t", lambda t: F.when(t["fault"] == "blank", F.lit(0)).when(t["fault"] == "duplicate", t["copies"]).otherwise(t["copies"] - 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    late = F.size(F.filter("_t", lambda t: t["fault"] == "truncated")).cast("long")
    pairs = F.zip_with(F.slice("_t", 1, F.size("_t") - 1), F.slice("_t", 2, F.size("_t")), lambda a, b: F.concat(a["_initial"], b["_initial"]))
    odd = F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))) + F.aggregate("_t", F.lit(0).cast("long"), lambda a, t: a + t["copies"] - 1)
    edge = W.partitionBy("conv_id").orderBy("_slice")
    held = held.select("conv_id", "_slice", F.concat_ws("", "_t.code").alias("codes"), F.col("_t.copies").alias("copies"),
                       F.struct(*[F.col("_t")[0][c].alias(c) for c in ORDER]).alias("_from"),
                       F.col("_t")[0]["_initial"].alias("_a"), F.element_at("_t", -1)["_initial"].alias("_z"),
                       own.alias("blank"), twice.alias("duplicate"), late.alias("truncated"), odd.alias("_odd"))
    held = held.withColumn("_z", F.lag("_z").over(edge)).withColumn("_blocks", F.count(F.lit(1)).over(W.partitionBy("conv_id")))
    held = held.withColumn("_last", F.lead("_slice").over(edge).isNull())
    seam = F.when(F.col("_z").isNotNull() & ~F.concat("_z", "_a").isin(*LEGAL), 1).otherwise(0)
    return cut(held.withColumn("illegal", F.col("_odd") + seam).drop("_a", "_z", "_odd"))


def edits(held: DataFrame, kind: str) -> DataFrame:
    """(conv_id, _slice, state, audit): the cheapest edits of every block, and the state before it.  ``kind``: type of conv_id."""

    def alone(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [walk(c, m, END, 0, True)[0] for c, m in zip(b.column("codes").to_pylist(), b.column("copies").to_pylist())]
        return pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("_slice"), pa.array([0] * len(found), pa.int32()), pa.array(found)], ["conv_id", "_slice", "state", "audit"])

    def matrices(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [matrix(c) for c in b.column("codes").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("_slice"), pa.array(found, pa.list_(pa.float64()))], ["conv_id", "_slice", "m"])

    def backward(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for parts in b.column("parts").to_pylist():
            v, ends = END, []
            for p in reversed(parts):
                ends.append({"_slice": p["_slice"], "end": list(v)})
                v = tuple(min(p["m"][4 * s + t] + v[t] for t in range(4)) for s in range(4))
            found.append(ends)
        return pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(found, pa.list_(pa.struct([("_slice", pa.int32()), ("end", pa.list_(pa.float64()))])))], ["conv_id", "e"])

    def four(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*[b.column(c).to_pylist() for c in ("codes", "copies", "end", "_last")])
        found = [[walk(c, m, tuple(e), s, z) for s in range(4)] for c, m, e, z in rows]
        return pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("_slice"), pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string())),
                                           pa.array([[s for _, s in f] for f in found], pa.list_(pa.int32()))], ["conv_id", "_slice", "audits", "exits"])

    def forward(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for parts in b.column("parts").to_pylist():
            s, states = 0, []
            for p in parts:
                states.append({"_slice": p["_slice"], "state": s})
                s = p["exits"][s]
            found.append(states)
        return pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(found, pa.list_(pa.struct([("_slice", pa.int32()), ("state", pa.int32())])))], ["conv_id", "e"])

    solo = map_batches(held.where("_blocks = 1").select("conv_id", "_slice", "codes", "copies"), alone, f"conv_id {kind}, _slice int, state int, audit string")
    several = held.where("_blocks > 1")
    m = map_batches(several.select("conv_id", "_slice", "codes"), matrices, f"conv_id {kind}, _slice int, m array<double>")
    m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_slice", "m"))).alias("parts"))
    ends = map_batches(m, backward, f"conv_id {kind}, e array<struct<_slice:int,end:array<double>>>").select("conv_id", F.inline("e"))
    known = join_on(several.select("conv_id", "_slice", "codes", "copies", "_last"), ends, ["conv_id", "_slice"])
    walked = cut(map_batches(known, four, f"conv_id {kind}, _slice int, audits array<string>, exits array<int>"))
    x = walked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_slice", "exits"))).alias("parts"))
    states = map_batches(x, forward, f"conv_id {kind}, e array<struct<_slice:int,state:int>>").select("conv_id", F.inline("e"))
    taken = join_on(walked, states, ["conv_id", "_slice"]).select("conv_id", "_slice", "state", F.element_at("audits", F.col("state") + 1).alias("audit"))
    return solo.unionByName(taken)


def in_order(turns: DataFrame, held: DataFrame, done: DataFrame) -> DataFrame:
    """Edits and texts of every conversation, in order: a block's audit comes before its first turn."""
    marks = join_on(held.select("conv_id", "_slice", "_from"), done, ["conv_id", "_slice"])
    marks = marks.select("conv_id", "_from.*", F.lit(0).alias("_text"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    rows = marks.unionByName(keyed(turns).withColumn("_text", F.lit(1))).repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", *ORDER, "_text").select("conv_id", "_text", "turn", "_known", "role", "text", "copies")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, turn, role, text) of every edit, conversation by conversation; (conv_id, None, ...) ends each."""
    conv, ops, at, state, opened = None, "", 0, 0, False

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(ops) and ops[at] == "I":
            at, state = at + 1, FILL[state]
            yield conv, "I", None, FILL_ROLE[state], ""

    for b in batches:
        for c, is_text, turn, known, role, text, copies in zip(*[b.column(k).to_pylist() for k in range(7)]):
            if opened and c != conv:
                yield from inserts()
                yield conv, None, None, None, None
            if not opened or c != conv:
                conv, ops, at, state, opened = c, "", 0, 0, True
            if not is_text:
                yield from inserts()
                ops, at = text, 0
                continue
            for _ in range(copies):
                yield from inserts()
                op, at = ops[at], at + 1
                if op == "R":
                    state = FILL[state]
                    role = FILL_ROLE[state]
                elif op == "K":
                    state = STEP[state][role[0]]
                yield conv, op, turn if known else None, role, text
    if opened:
        yield from inserts()
        yield conv, None, None, None, None


def repaired(turns: DataFrame, held: DataFrame, done: DataFrame, kind: str) -> DataFrame:
    """The repaired turns: conv_id, place, edit, turn, role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, place = ["conv_id", "place", "edit", "turn", "role", "text"], [], 0
        kinds: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield b

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for conv, op, turn, role, text in edited(seen()):
            if op is None:
                place = 0
            elif op != "D":
                rows.append((conv, place, op, turn, role, text))
                place += 1
            if len(rows) >= 2048:
                yield out()
                rows.clear()
        if rows:
            yield out()

    return in_order(turns, held, done).mapInArrow(run, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def digests(turns: DataFrame, held: DataFrame, done: DataFrame, kind: str) -> DataFrame:
    """(conv_id, repaired_sha256): hash of the repaired ``role:text`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kinds, h, some = [], [], hashlib.sha256(), False

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field("conv_id").type, pa.string()]
                yield b

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["conv_id", "repaired_sha256"])

        for conv, op, _, role, text in edited(seen()):
            if op is None:
                rows.append((conv, h.hexdigest()))
                h, some = hashlib.sha256(), False
                if len(rows) >= 8192:
                    yield out()
                    rows.clear()
            elif op != "D":
                h.update((("\n" if some else "") + role + ":" + text).encode())
                some = True
        if rows:
            yield out()

    return in_order(turns, held, done).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """What ``repaired``, ``digests`` and ``report`` take: the turns, their blocks, the edits and the type of conv_id."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    held = blocks(faults(turns))
    return turns, held, cut(edits(held, kind)), kind


def report(original: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for every ``conv_id`` of ``original``: faults of ``turns``, the cheapest edits and the repaired text's hash."""
    parts = repair(turns)
    _, held, done, kind = parts
    counts = held.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    numbers = keyed(turns).where("_known").select("conv_id", "turn").distinct()
    numbers = numbers.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    whole = done.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_slice", "audit"))).alias("_p")).select("conv_id", F.concat_ws("", "_p.audit").alias("audit"))
    cost = costs(held, done, kind)
    res = original.select("conv_id").distinct()
    for side in (numbers, counts, cost, whole, digests(*parts)):
        res = join_on(res, side, ["conv_id"], "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return res.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def costs(held: DataFrame, done: DataFrame, kind: str) -> DataFrame:
    """(conv_id, cost): what the edits of every conversation cost."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for codes, copies, audit in zip(*[b.column(c).to_pylist() for c in ("codes", "copies", "audit")]):
            letters = "".join(c + "x" * (m - 1) for c, m in zip(codes, copies))
            kept = zip((op for op in audit if op != "I"), letters)
            found.append(4 * audit.count("D") + 3 * (audit.count("R") + audit.count("I")) + 3 * sum(op != "D" and c.isupper() for op, c in kept))
        return pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(found, pa.int64())], ["conv_id", "cost"])

    rows = join_on(held.select("conv_id", "_slice", "codes", "copies"), done, ["conv_id", "_slice"])
    return map_batches(rows.select("conv_id", "codes", "copies", "audit"), batch, f"conv_id {kind}, cost long").groupBy("conv_id").agg(F.sum("cost").alias("cost"))
