import itertools
import zlib

import numpy as np
import pytest

from runweave.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    import __spark_entry__ as e

    return {r["doc_id"]: r for r in e.queries()["op7_language_crf"](spark, SF).collect()}


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_languages(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, rows):
    docs = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [(r["lang_pred"], docs[d][0]) for d, r in rows.items() if r["held_out"] and docs[d][0] and any(c.isalpha() for c in docs[d][1] or "")]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) > 0.97
    for lang in {b for _, b in held}:
        own = [a == b for a, b in held if b == lang]
        assert sum(own) / len(own) > 0.9


def test_marginals_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    emission, transition, start = rng.random((5, 2, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    lengths = np.array([5, 3])
    got = dict(langid.marginals(emission.copy(), lengths, transition, start))
    for s, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = start[path[0]] * np.prod([emission[t, s, path[t]] for t in range(n)]) * np.prod([transition[a, b] for a, b in itertools.pairwise(path)])
            for t in range(n):
                want[t, path[t]] += p
        for t in range(n):
            assert got[t][s] == pytest.approx(want[t] / want[t].sum())
    assert got[4].shape == (1, 3)


def test_code_switched_text(spark, model):
    docs = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 800").orderBy("doc_id").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and "!!" not in r["text"] and "***" not in r["text"]:
            docs.setdefault(r["lang"], r["text"].split()[-40:])
    a, b = docs["de"], docs["es"]
    tags = [t for _, t in langid.Labeller(model).words(" ".join(a + b))]
    assert sum(t == "de" for t in tags[:40]) > 34 and sum(t == "es" for t in tags[40:]) > 34


def test_hashes_of_a_word_do_not_depend_on_its_neighbours():
    slot, first = langid.hashes(["abc", "", "étude.", "x"])
    for i, w in enumerate(["abc", "", "étude.", "x"]):
        own, _ = langid.hashes([w])
        assert sorted(slot[first[i] : [*first, len(slot)][i + 1]]) == sorted(own)


def test_blocks_and_memory_do_not_change_results(model, monkeypatch):
    texts = ["the thing and the heating " * n for n in (1, 50, 3)] + ["", "12 34", "die und der " * 7]
    whole = langid.Labeller(model).means(texts)
    monkeypatch.setattr(langid, "CELLS", 7)
    monkeypatch.setattr(langid, "MEMORY", 2)
    small = langid.Labeller(model)
    assert np.concatenate([small.means([t]) for t in texts]) == pytest.approx(whole)


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 -- 34", "en"), (None, "the and of the", "x"), (5, "the and of the", "x"), (6, "the " * 50_000, "x")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict_languages(docs, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[None] == got[5] and got[6][0] == "en"
    assert langid.predict_languages(docs.limit(0), model).count() == 0
    assert langid.fit_languages(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict_languages(docs, None).collect()} == {"und"}
