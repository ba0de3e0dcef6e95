import hashlib
import itertools
import random
import zlib

import pytest

from dealsight.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, copies2 long, audit string, _slice int, state int, cost string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FILL = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Best (cost, audit) by a plain forward search over whole rows, kept per state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {"": (0, "", ())}

    def relax(b):
        for _ in range(3):
            for s, (c, a, o) in list(b.items()):
                t = FILL[s]
                new = (c + 3, a + "I", (*o, f"{ROLE[t]}:"))
                if t not in b or new[:2] < b[t][:2]:
                    b[t] = new
        return b

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def put(s, c, a, o):
            if s not in new or (c, a) < new[s][:2]:
                new[s] = (c, a, o)

        for s, (c, a, o) in relax(best).items():
            put(s, c + 4, a + "D", o)
            if fault not in ("blank", "duplicate"):
                late = 3 if fault else 0
                if role[:1] in NEXT[s]:
                    put(NEXT[s][role[:1]], c + late, a + "K", (*o, f"{role}:{text}"))
                put(FILL[s], c + late + 3, a + "R", (*o, f"{ROLE[FILL[s]]}:{text}"))
        best = new
    relax(best)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best) if rows else (0, "", ())
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def noise(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((c, rng.choice([t, t, t + 3, t, None, 2]), role, rng.choice(["Yes.", "no", "What?", "", " \n", None, f"turn {t}!", f"open {t}", "é. \t"])))
    return rows + rows[::5]


def check(spark, original, rows):
    """The report of ``rows`` against brute force for each conversation."""
    d = spark.createDataFrame([(*r, 1, "a", 0, 0, "c") for r in rows], SCHEMA)
    o = spark.createDataFrame([(*r, 1, "a", 0, 0, "c") for r in original], SCHEMA)
    got = {r["conv_id"]: r.asDict() for r in repair.report(o, d).collect()}
    assert set(got) == {r[0] for r in original}
    for conv, found in got.items():
        found.pop("conv_id")
        assert found == brute([(r[0], r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == conv]), conv
    return got


def test_report_equals_brute_force(spark):
    rows = noise(1, 60, 9) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi!")]
    check(spark, rows, rows)


def test_damage(spark):
    rows = noise(2, 80, 9)
    df = spark.createDataFrame([(*r, 1, "a", 0, 0, "c") for r in rows], SCHEMA)
    got = [(r.conv_id, r.turn, r.role, r.text) for r in repair.damage(df).collect() for _ in range(r.copies)]
    key = lambda r: tuple((x is not None, x or "" if isinstance(x, str) else x or 0) for x in r)
    assert sorted(got, key=key) == sorted(damaged(rows), key=key)
    found = {r["conv_id"]: r["audit"] for r in repair.report(df, repair.damage(df)).collect()}
    want = {c: brute([r for r in damaged(rows) if r[0] == c])["audit"] for c in {r[0] for r in rows}}
    assert found == want


def test_one_conversation_over_many_slices(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "same.", ""])) for t in range(4000)]
    rows += [(8, 1, "user", "again.")] * 500 + [(8, 2, "assistant", "ok.")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        check(spark, rows, rows)
        parts = repair.repair(spark.createDataFrame([(*r, 1, "a", 0, 0, "c") for r in rows], SCHEMA))
        assert parts[1].where("conv_id = 7").count() > 8
        lines = [r for r in repair.repaired(*parts).where("conv_id = 7").orderBy("place").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == brute([r for r in rows if r[0] == 7])["repaired_sha256"]
    assert [r.place for r in lines] == list(range(len(lines)))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 17, 100])
def test_walk_keeps_square_root_many_vectors(n):
    rng = random.Random(n)
    codes = "".join(rng.choice("suaoSUAOx") for _ in range(n))
    v = repair.END
    for c in reversed(codes):
        v = v if c == "x" else repair.back(v, c)
    audit, state = repair.walk(codes, [1] * n, repair.END, 0, True)
    kept = zip((a for a in audit if a != "I"), codes)
    cost = 4 * audit.count("D") + 3 * (audit.count("I") + audit.count("R")) + 3 * sum(a != "D" and c.isupper() for a, c in kept)
    assert cost == v[0] + 4 * codes.count("x") and state in (0, 3)


def test_empty_table_and_no_turns_left(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.report(empty, repair.damage(empty)).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "x", 1, "a", 0, 0, "c")], SCHEMA)
    got = repair.report(one, one.where("false")).first()
    assert (got.cost, got.audit, got.gaps, got.repaired_sha256) == (0, "", 0, hashlib.sha256().hexdigest())
