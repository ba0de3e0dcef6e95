import numpy as np

from dealsight.llm import licenses
from tests.llm.fixture_rows import awkward, documents, prose


def brute_alignment(doc, template):
    """Best local alignment without a band: (score, matched words)."""
    best, rows = (0, 0), [(0, 0)] * (len(doc) + 1)
    for word in template:
        new = [(0, 0)]
        for j, other in enumerate(doc):
            same = word == other
            s, m = rows[j]
            cell = max((s + (licenses.MATCH if same else licenses.MISMATCH), m + same), (rows[j + 1][0] + licenses.GAP, rows[j + 1][1]),
                       (new[j][0] + licenses.GAP, new[j][1]))
            new.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, new[-1])
        rows = new
    return best


def test_alignment_equals_the_full_table_for_edits_within_the_band():
    index = licenses.Index.build(licenses.TEMPLATES)
    rng = np.random.default_rng(1)
    for t, words in enumerate(index.words):
        if len(words) < 8:
            continue
        doc = [w for w in words.tolist() if rng.random() > 0.05]
        doc.insert(len(doc) // 2, -1)
        doc = [-1] * 5 + doc + [-1] * 5
        matched, start, end = licenses.align(np.array(doc), words, 5)
        assert matched == brute_alignment(doc, words.tolist())[1] and start >= 5
        assert end <= len(doc) - 5


def found(spark, rows, **options):
    return sorted((r.doc_id, r.license, r.start, r.end, r.coverage) for r in licenses.scan(documents(spark, rows), **options).collect())


def test_whole_edited_and_repeated_notices(spark):
    mit, apache = licenses.TEMPLATES["mit-full"], licenses.TEMPLATES["apache-2.0"]
    edited = mit.replace("hereby granted", "hereby GRANTED").replace("publish, distribute,", "publish,")
    rows = [(100, f"é {prose(1, 30)}\n{mit}\n{prose(2, 30)}"), (101, edited), (102, f"{apache} {prose(3, 20)} {apache}"), (103, prose(4, 500)),
            (104, "licensed under the moon, version two of the story")]
    got = found(spark, rows + awkward())
    assert [(d, n) for d, n, *_ in got] == [(100, "mit-full"), (101, "mit-full"), (102, "apache-2.0"), (102, "apache-2.0")]
    text = dict(rows)
    for d, n, s, e, coverage in got:
        assert coverage == 1.0 if d != 101 else 0.95 < coverage < 1.0
        if d != 101:
            assert text[d][s:e] == licenses.TEMPLATES[n]


def test_adjacent_notices_and_lists_are_all_found(spark):
    short = ("mit", "cc-by-nc-4.0", "apache-2.0")
    rows = []
    for k, name in enumerate(short):
        notice = licenses.TEMPLATES[name]
        rows.append((100 + k, f"{notice} {notice}"))
        rows += [(100 * gap + 200 + k, "\n".join(f"{prose(i, gap)} {notice}" for i in range(40))) for gap in range(1, 13)]
    mixed = [licenses.TEMPLATES[short[i % 3]] for i in range(60)]
    rows.append((5000, " ".join(mixed)))
    whole = licenses.TEMPLATES["isc-full"]
    rows.append((5001, f"{whole} {whole} word {whole}"))
    got = found(spark, rows)
    want = []
    for d, text in rows:
        for name in (*short, "isc-full"):
            notice, at = licenses.TEMPLATES[name], text.find(licenses.TEMPLATES[name])
            while at >= 0:
                want.append((d, name, at, at + len(notice), 1.0))
                at = text.find(notice, at + 1)
    assert got == sorted(want)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_a_long_list_of_notices_has_right_spans(spark):
    line = "é libfoo: Released under the MIT License. "
    text = line * 3000
    rows = licenses.scan(documents(spark, [(1, text)])).where("license = 'mit'").collect()
    assert len(rows) == 3000
    assert all(text[r.start:r.end].startswith("Released") and text[r.start:r.end].endswith("License.") for r in rows)
