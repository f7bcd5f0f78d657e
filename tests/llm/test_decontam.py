import random

import numpy as np
import pytest

from runweave.llm import decontam

SF = "/root/testdata/sf0.01"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def brute(docs, items):
    """Every span of every document against every passage, no retrieval in between."""
    ps = decontam.passages(items)
    df = {}
    for _, t in docs:
        for w in set(decontam.words_of(t)):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: np.log((len(docs) + 1) / (df.get(w, 0) + 1))
    names = {w: i for i, w in enumerate(sorted({w for p in ps for w in p.words}))}
    out = {}
    for d, t in docs:
        words, out[d] = decontam.words_of(t), set()
        have = set(words)
        for p in ps:
            if sum(w in have for w in p.words) < decontam.need_of(len(p.words)):
                continue
            answer = p.answer | set(sorted(set(p.words), key=lambda w: (-idf(w), names[w]))[:3])
            span = len(p.words) + len(p.words) // 4 + 2
            own, need = set(p.words), decontam.need_of(len(p.words))
            known = np.concatenate([[0], np.cumsum([w in own for w in words])])  # a subsequence has known words only
            ends = np.minimum(np.arange(len(words)) + span, len(words))
            for i in np.flatnonzero(known[ends] - known[:-1] >= need).tolist():
                part = words[i : i + span]
                if words[i] in own and lcs(p.words, [w for w in part if w in own]) >= need and len(answer & set(part)) >= decontam.ANSWER * len(answer):
                    out[d].add(p.item)
                    break
    return out


def test_query_against_brute_force(spark):
    import __spark_entry__ as e

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = e.queries()["op10_latent_decontamination"](spark, SF).collect()
    got, want = {r["doc_id"]: set(r["item_ids"]) for r in rows}, brute(docs, items)
    assert len(rows) == len(docs) and all(r["leaked"] == bool(r["item_ids"]) for r in rows)
    links = sum(map(len, want.values()))
    assert links > 10 and not [d for d in got if got[d] - want[d]]
    assert sum(len(got[d] & want[d]) for d in want) >= 0.99 * links
    joined = {d: " ".join(w.decode() for w in decontam.words_of(t)) for d, t in docs}
    for item, text in items:
        whole = " ".join(w.decode() for w in decontam.words_of(text))
        assert all(item in got[d] for d, t in joined.items() if whole in t)


def test_paraphrases_of_all_lengths(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(40)]
    pool = [word() for _ in range(4000)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(pool) for _ in range(n)]
    items = [(i, prose(n)) for i, n in enumerate([5, 8, 12, 15, 20, 24, 25, 30, 40, 48, 59, 64, 65, 100, 200] * 3)]
    docs, planted = [], {}
    for i, own in items:
        for kind in range(3):
            new = list(own)
            for at in sorted(rng.sample(range(len(own)), int(0.1 * len(own))), reverse=True):
                if kind == 1:
                    new[at] = word()
                elif kind == 2:
                    del new[at]
            d = len(docs)
            planted[d] = (i, kind)
            docs.append((d, " ".join([*prose(rng.randint(0, 300)), *[w.title() + "," for w in new], *prose(rng.randint(0, 300))])))
    clean = len(docs)
    docs += [(clean + j, " ".join(prose(400))) for j in range(60)]
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    assert all(not got[d] for d in range(clean, len(docs)))
    assert all(i in got[d] for d, (i, kind) in planted.items() if kind == 0)
    assert sum(i in got[d] for d, (i, _) in planted.items()) >= 0.9 * len(planted)
    assert sum(len(got[d] - {i}) for d, (i, _) in planted.items()) == 0


def reworded(share, seed=4, n=200):
    """Items of 16 to 64 words, each in a document of its own with ``share`` of its words replaced, and clean documents after them."""
    rng = random.Random(seed)
    common, pool = ([f"{c}{i}" for i in range(k)] for c, k in (("c", 60), ("p", 3000)))
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(pool) for _ in range(n)]
    items = [(i, prose(rng.randint(16, 64))) for i in range(n)]
    docs = []
    for i, own in items:
        new = list(own)
        for at in rng.sample(range(len(own)), int(share * len(own))):
            new[at] = rng.choice(pool)
        docs.append((i, " ".join([*prose(rng.randint(0, 300)), *new, *prose(rng.randint(0, 300))])))
    docs += [(n + j, " ".join(prose(500))) for j in range(100)]
    return docs, [(i, " ".join(w)) for i, w in items]


def found(spark, docs, items):
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {r["doc_id"]: set(r["item_ids"]) for r in got}


@pytest.mark.parametrize(("share", "least"), [(0.2, 0.97), (0.3, 0.9)])
def test_reworded_passages(spark, share, least):
    docs, items = reworded(share)
    got, want = found(spark, docs, items), brute(docs, items)
    assert all(got[d] <= want[d] for d in got)
    assert sum(d in got[d] for d, _ in items) >= least * len(items)
    assert not any(got[d] - {d} for d in got)


def test_cosine_decides_what_is_checked(spark, monkeypatch):
    docs, items = reworded(0.2, n=60)
    group = decontam.build_group(spark.createDataFrame(docs, "doc_id long, text string"), decontam.passages(items))
    block, ids = group.blocks[0], [group.ids(t) for _, t in docs]
    flat = block.local[np.concatenate([np.array([*x, *[0] * 200]) for x in ids])]

    def near(cosine):
        monkeypatch.setattr(decontam, "COSINE", cosine)
        return sum(len(places) for b in range(0, len(flat), decontam.PIECE) for places, _, _ in block.candidates(flat, b))

    every, some = near(-2), near(0.4)
    assert 0 < some < 0.1 * every
    monkeypatch.setattr(decontam, "COSINE", 0.4)
    right = group.search(ids)
    assert sum(map(len, right)) >= 0.97 * len(items)
    block.latent = np.random.default_rng(1).standard_normal(block.latent.shape).astype(np.float32)  # other directions than the SVD's
    assert sum(map(len, group.search(ids))) < 0.5 * sum(map(len, right))


def test_long_texts_are_searched_in_pieces(spark):
    docs, items = reworded(0.0, n=40)
    whole = [(0, " ".join(t for _, t in docs) + " filler" * 20 * decontam.PIECE + " " + items[0][1])]
    assert found(spark, whole, items)[0] == set(range(40))
    alone = [(0, "filler " * (k - 1) + items[0][1]) for k in (decontam.PIECE - 30, decontam.PIECE, 2 * decontam.PIECE - 200)]
    assert all(found(spark, [d], items)[0] == {0} for d in alone)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert decontam.common_subsequence(a, b) == lcs(a, b)


def test_svd_spans_the_leading_directions(spark):
    rng = np.random.default_rng(2)
    dense = rng.standard_normal((60, 6)) @ rng.standard_normal((6, 40)) + 0.01 * rng.standard_normal((60, 40))
    df = spark.createDataFrame([(list(range(40)), [float(x) for x in row]) for row in dense], "terms array<long>, weights array<double>")
    basis = decontam.randomised_svd(df, 40, 6)
    want = np.linalg.svd(dense)[2][:6].T
    assert basis.shape == (40, 6) and np.linalg.norm(basis @ basis.T - want @ want.T) < 1e-3


@pytest.mark.parametrize("block", [1, 4096])
def test_odd_rows_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    text = "seven green birds sing a strange old song near water"
    docs = spark.createDataFrame([(1, None, [1]), (2, "", [2]), (3, f"x {text} y", [3]), (3, f"x {text} y", [3]), (None, text.upper(), None), (5, "seven green " * 4000, None)], "doc_id long, text string, Item_IDs array<int>")
    bench = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "too short"), (5, text), (None, text), (6, "other words entirely stand in this one here")], "item_id long, text string")
    got = decontam.leaks(docs, bench)
    assert got.columns == [*docs.columns, "item_ids_"]
    assert sorted((r["doc_id"] or 0, r["item_ids_"]) for r in got.collect()) == [(0, [1, 5]), (1, []), (2, []), (3, [1, 5]), (3, [1, 5]), (5, [])]
    kept = decontam.decontaminate(docs, bench)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 6


def test_verbatim_copies_of_many_passages(spark):
    """More passages than the SVD has dimensions, among words of other passages, some of them repeated."""
    rng = random.Random(9)
    common, pool = ([f"{c}{i}" for i in range(n)] for c, n in (("c", 60), ("p", 6000)))
    prose = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(pool) for _ in range(n)]
    items = [(i, prose(rng.randint(16, 59))) for i in range(1100)]
    around = lambda i: prose(100) if i % 2 else [rng.choice(pool)] * 100
    docs = [(i, " ".join([*around(i), *own, *around(i)])) for i, own in items]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in got if r["doc_id"] not in r["item_ids"]] == []
