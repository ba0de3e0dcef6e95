from dealsight.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, _n long, kept string, start string, id string"


def turns(rows):
    """{conv_id: [(role, text), ...]} as rows in mixed order, with columns of clashing names."""
    out = [(c, t, r, x, 1, "k", "s", "i") for c, ts in rows.items() for t, (r, x) in enumerate(ts)]
    return out[1::2] + out[::2]


def brute(rows):
    out = {}
    for a, x in rows.items():
        longer = [b for b, y in rows.items() if len(y) > len(x) and y[:len(x)] == x]
        if longer:
            out[a] = min(longer, key=lambda b: (-len(rows[b]), b))
        else:
            out[a] = min(b for b, y in rows.items() if y == x)
    return out


def snapshots():
    base = [("user", "hi"), ("assistant", "hello"), ("user", "tell me\nmore"), ("assistant", "<|im_end|> no"), ("user", None)]
    rows = {10 + k: base[:k + 1] for k in range(5)}
    rows |= {20: base[:3], 21: [*base[:2], ("user", "other")], 30: base, 31: [("user", "hi")], 40: [("user", "")], 41: [("user", None)], 42: [(None, "")], 50: [("a", "bc")], 51: [("ab", "c")]}
    rows |= {60: [("user", "x")] * 3, 61: [("user", "x")] * 2, 70: [("user", str(k)) for k in range(3000)], 71: [("user", str(k)) for k in range(2500)]}
    return rows


def test_kept_in_equals_brute_force(spark):
    rows = snapshots()
    found = {r.conv_id: r for r in chat.collapse(chat.prefixes(spark.createDataFrame(turns(rows), SCHEMA))).collect()}
    want = brute(rows)
    assert {c: r.kept_in for c, r in found.items()} == want
    assert all(r.kept == (want[c] == c) and r.n_turns == len(rows[c]) for c, r in found.items())


def test_rendered_turns_and_offsets(spark):
    rows = snapshots()
    want = brute(rows)
    got = {}
    for r in chat.render(spark.createDataFrame(turns(rows), SCHEMA)).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(want.values())
    for c, rs in got.items():
        at = 0
        for r, (role, text) in zip(sorted(rs, key=lambda r: r.turn_no), rows[c]):
            clean = (text or "").replace("<|im_end|>", "<| im_end |>")
            assert r.rendered == f"<|im_start|>{role or 'unknown'}\n{clean}<|im_end|>\n" and r.start == at
            assert r.collapsed == list(want.values()).count(c) - 1
            at += len(r.rendered)


def test_null_ids_turns_and_repeated_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "b"), (1, None, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "", "", "") for r in rows], SCHEMA)
    found = {r.conv_id: (r.kept, r.kept_in, r.n_turns) for r in chat.collapse(chat.prefixes(df)).collect()}
    assert found == {None: (False, 1, 2), 1: (True, 1, 2), 2: (True, 2, 2)}


def test_plan_is_native_and_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = chat.render(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
