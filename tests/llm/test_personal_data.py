import hashlib
import random
import re

from dealsight.llm import pii
from tests.llm.fixture_rows import awkward, documents, prose

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")) or kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def card(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def person(seed):
    rng = random.Random(seed)
    n = f"{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    return [f"mail{seed}@site{seed}.example.com", f"10.{seed % 256}.7.{rng.randrange(256)}", card(rng), f"+1 (555) {n}"], n


LETTERS = str.maketrans("0123456789", "abcdefghij")


def corpus(n=80):
    rows = []
    for i in range(n):
        words, (own, short) = prose(i, 60).translate(LETTERS).split(), person(i)
        words[10] = own[i % 4]
        if i % 4 == 3:
            words[40] = words[55] = f"(555) {short}"  # the number again, without its prefix
        words[20] = str(i)
        rows.append((i, " ".join(words)))
    return rows


def test_base_spans_equal_brute_force():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.1@.+-2 5(0)%9b\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute(text), text
    for _, text in corpus():
        assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("9" * 200_000 + ".1") == []


def test_field_adds_distant_repeats_and_keeps_base_spans(spark):
    rows = corpus() + [(1000 + i, prose(i, 80)) for i in range(20)] + [(2000 + k, t) for k, (_, t) in enumerate(awkward())]
    docs = documents(spark, rows)
    field = pii.fit(docs)
    assert field is not None
    text = dict(rows)
    for r in pii.find(docs, field).collect():
        base = pii.base_spans(text[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert not base or set(pii.written(base).split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        if r.doc_id >= 1000:
            assert r.spans == pii.written(base)
        elif r.doc_id % 4 == 3:
            assert r.spans.count("phone") == 3, (text[r.doc_id], r.spans)


def test_every_one_of_many_repeats_gets_the_label():
    import numpy as np

    labels, unary = len(pii.KINDS) + 1, np.zeros((pii.N_FEATURES, len(pii.KINDS) + 1))
    unary[0, 0] = 2.0  # a word by itself is taken for none
    field = pii.Field(unary, np.zeros((labels, labels)), 3.0 * np.eye(labels))
    for at in (0, 25, 50):  # the full number first, amid its repeats, and last
        said = ["15550123456"] * 51
        without = " ".join(f"{prose(k, 30).translate(LETTERS)} {x}" for k, x in enumerate(said))
        assert pii.spans_of(without, field) == ([], [])
        said[at] = "+15550123456"
        text = " ".join(f"{prose(k, 30).translate(LETTERS)} {x}" for k, x in enumerate(said))
        base, spans = pii.spans_of(text, field)
        assert len(base) == 1 and [k for _, k, _ in spans] == [3] * 51
        assert "555" not in pii.masked(text, spans)
        g = pii.Graph.of(text, base)
        assert np.allclose(field.beliefs(g), field.beliefs(g, 2000), atol=1e-3) and len(g.skip) < 3 * len(said)


def test_message_passing_is_exact_on_a_chain():
    import itertools
    import numpy as np

    rng = np.random.default_rng(2)
    field = pii.Field(rng.normal(size=(3, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    x = rng.normal(size=(3, 3))
    g = pii.Graph([0, 2, 4], [1, 3, 5], x, np.zeros(3, int), np.array([[0, 1]]), np.array([[1, 2]]))
    want = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        p = np.exp(sum((x @ field.unary)[i, y[i]] for i in range(3)) + field.chain[y[0], y[1]] + field.skip[y[1], y[2]])
        for i in range(3):
            want[i, y[i]] += p
    assert np.allclose(field.beliefs(g, 60), want / want.sum(1, keepdims=True), atol=1e-6)


def test_redaction_keeps_columns_and_clean_texts(spark):
    docs = documents(spark, corpus(20) + [(500, None), (501, ""), (502, "clean text")])
    out = pii.redact(docs, None)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[500].text is None and rows[501].text == "" and rows[502].text == "clean text"
    assert "[EMAIL]" in rows[0].text and "@" not in rows[0].text and rows[0].n_chars == len(rows[0].text)


def test_empty_table(spark):
    docs = documents(spark, [])
    assert pii.fit(docs) is None and pii.find(docs, None).count() == 0 == pii.redact(docs, None).count()


def test_rare_spans_still_train_the_field(spark):
    """Few documents hold personal data, far fewer than are sampled; long ones take part with an excerpt."""
    rows = [(k, t) for k, t in corpus()[:8]] + [(10_000 + i, prose(i, 60) + f" {i} items") for i in range(400)]
    docs = documents(spark, rows)
    assert pii.fit(docs, fit_docs=20, plain_docs=5) is not None
    text = " ".join([corpus()[3][1]] * 200)
    g = pii.Graph.of(text, pii.base_spans(text))
    small = pii.excerpt(g, 16)
    assert len(small.x) == 16 and (small.y > 0).any() and all(len(e) == 0 or (e.min() >= 0 and e.max() < 16) for e in (small.chain, small.skip))
    assert pii.fit(documents(spark, [(1, text), (2, prose(2, 50))])) is not None
