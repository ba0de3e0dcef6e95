"""Every stage on its own input, held against brute-force versions, and the run as a whole."""
import re

import pytest

import corpus_pipeline
from dealsight.llm import packing, pii, queries
from tests.llm.fixture_rows import awkward, documents, prose
from tests.llm.test_near_duplicates import brute as components
from tests.llm.test_personal_data import corpus, person

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    junk = [(1000 + i, " ".join(f"{w}###" for w in prose(i, 120, 5000).split())) for i in range(40)]
    rows = corpus(60) + [(100 + i, prose(300 + i, 150, 5000)) for i in range(100)] + [(200, prose(300, 150, 5000)), (201, prose(300, 150, 5000) + " x")] + junk
    rows += [(2000 + k, t) for k, (_, t) in enumerate(awkward())]
    documents(spark, [(d, t, "b" if d % 3 else None) for d, t in rows]).write.parquet(f"{out}/documents.parquet")
    marks = [(100 + i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(25)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder, tmp_path):
    docs = queries.table(spark, folder, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "best_fit_packing" or docs.columns == columns
    ids = {n: [r.doc_id for r in rows] for n, rows in seen.items()}
    good = [d for d, t in before.items() if 0 <= d < 202]
    assert set(good) <= set(ids["quality_rules"]) and not any(1000 <= d < 1040 for d in ids["quality_rules"])
    comp = components([(d, before[d]) for d in ids["quality_rules"]])
    assert sorted(ids["minhash_near_dedup"]) == sorted(d for d in comp if comp[d] == d)
    assert ids["personal_data"] == ids["minhash_near_dedup"] or sorted(ids["personal_data"]) == sorted(ids["minhash_near_dedup"])
    for r in seen["personal_data"]:
        assert not pii.base_spans(r.text) and (pii.base_spans(before[r.doc_id]) or "[" in r.text or r.text == before[r.doc_id])
    words = sum(len(WORD.findall(r.text)) for r in seen["personal_data"])
    mixed = sum(len(WORD.findall(r.text)) for r in seen["source_mixing"])
    # the fractional repetition of each of the two sources ends with a whole document or without it
    size = {r.doc_id: len(WORD.findall(r.text)) for r in seen["personal_data"]}
    largest = [max(size[r.doc_id] for r in seen["personal_data"] if r.source == s) for s in {r.source for r in seen["personal_data"]}]
    assert abs(mixed - 1.5 * words) <= sum(largest) / 2 + 4
    whole = {r.doc_id: r.text for r in seen["personal_data"]}
    assert all(r.text == whole[r.doc_id] for r in seen["source_mixing"])
    ids_of = packing.WordIds(queries.packing_vocabulary())
    tokens = sum(len(ids_of.encode(r.text)) // 4 + 1 for r in seen["source_mixing"])
    assert sum(r.length for r in seen["best_fit_packing"]) == tokens


def test_run_gives_the_rows_of_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
