from collections import defaultdict

import pytest

from runweave.llm import decontam, linededup, quality, simhash
from .test_decontam import brute as leaks_by_brute_force
from .test_linededup import brute as lines_by_brute_force
from .test_simhash import classes_of, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs.collect())
    return out


def test_quality_stage(spark, stages):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), hold=None)
    scores = model.scores([r["text"] for r in stages[0]])
    assert sorted(stages[1]) == sorted(r for r, s in zip(stages[0], scores, strict=True) if s >= 0.5)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(stages[1]) > 0.7 * len(stages[0])


def test_line_stage(stages):
    want = {}
    for r, (d, text) in zip(stages[1], lines_by_brute_force([(r["doc_id"], r["text"]) for r in stages[1]], linededup.THRESHOLD, linededup.MIN_CHARS), strict=True):
        if text == r["text"] or any(x.strip(" \t\r\x0b\x0c") for x in text.split("\n")):
            want[d] = text
    assert {r["doc_id"]: r["text"] for r in stages[2]} == want
    assert all(r["lang"] is not None for r in stages[2])


def test_near_duplicate_stage(stages):
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in stages[2]}
    classes = classes_of(fps)
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(set(classes.values()))
    texts = {r["doc_id"]: r["text"] for r in stages[2]}
    assert all(r["text"] == texts[r["doc_id"]] for r in stages[3]) and simhash.BUDGET == 3


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = leaks_by_brute_force([(r["doc_id"], r["text"]) for r in stages[3]], items)
    assert sorted(r["doc_id"] for r in stages[4]) == sorted(d for d, x in leaked.items() if not x)
    assert decontam.SHARE == 0.8


def test_packing_stage(stages):
    places = defaultdict(list)
    for r in stages[5]:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in stages[5]} == {r["doc_id"] for r in stages[4]}
    for items in places.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:], strict=False)) and sum(n for _, n in items) <= 1024


def test_run_gives_the_last_stage(spark, stages):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[5]}


def test_empty_table_passes_every_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, docs, SF)
        assert new.count() == 0
        assert i == len(corpus_pipeline.STAGES) - 1 or new.columns == docs.columns
        docs = new
