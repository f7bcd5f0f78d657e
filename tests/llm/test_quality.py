import zlib

import pytest

from runweave.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    import __spark_entry__ as e

    return {r["doc_id"]: r for r in e.queries()["op6_quality_classifier"](spark, SF).collect()}


def test_held_out_accuracy(spark, scored):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(scored[d]["predicted"], q) for d, q in labels.items() if scored[d]["held_out"]]
    assert len(held) > 80 and sum(p == q for p, q in held) / len(held) > 0.95
    bad = [p for p, q in held if q == 0]
    assert sum(p == 0 for p in bad) / len(bad) > 0.8


def test_every_row_has_its_fold_and_a_probability(spark, scored):
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d, r in scored.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (None, "", 1.0), (3, "the thing " * 9, 1.0), (3, "the thing " * 9, 1.0), (4, "zz! " * 60000, 0.0)], "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (9, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, hold=None)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_without_labels_the_prior_is_the_score(spark):
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    model = quality.fit_quality(none, none)
    assert model.scores(["a", None]).tolist() == [0.5, 0.5]


def test_long_text_counts_to_its_end():
    model = quality.QualityModel(b"", b"", 1.0, 0.0)
    assert model.differences(["a" * 100_000])[0] == 0
