import re

import numpy as np
import pytest

from runweave.llm import graph, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(fps, budget=3):
    """Brute force: least key reachable over all pairs within the budget."""
    keys = list(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", "  \t", "One", "two Words", "É ß ÀB c d E", "a b c d e f g " * 50, "no\xa0break   here x y z", "İ I K Å end of it"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_against_brute_force(spark):
    import __spark_entry__ as e

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = e.queries()["op8_simhash_near_dedup"](spark, SF).collect()
    fps = {d: plain_fingerprint(t) for d, t in docs.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == fps
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes_of(fps)


@pytest.mark.parametrize("crowd", [20_000, 5])
def test_chains_families_and_crowded_blocks(spark, crowd):
    rng = np.random.default_rng(crowd)
    values = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    for start in (0, 0x0123456789ABCDEF, 2**64 - 1):
        value = start
        for _ in range(40):
            values.append(value)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                value ^= 1 << int(b)
    base = 0x5A5A << 48
    values += [base | int(x) for x in rng.integers(0, 1 << 14, 80)] + [values[0]] * 5
    fps = dict(enumerate(values))
    signed = [(d, int(np.uint64(v).view(np.int64))) for d, v in fps.items()]
    rows = simhash.classes(spark.createDataFrame(signed, "doc_id long, fp long"), crowd=crowd).collect()
    got = {int(np.int64(r["fp"]).view(np.uint64)): r["component_id"] for r in rows}
    assert {d: got[v] for d, v in fps.items()} == classes_of(fps)


def test_trie_finds_each_pair_once():
    rng = np.random.default_rng(1)
    groups = np.sort(rng.integers(0, 4, 900))
    values = rng.integers(0, 1 << 12, 900).astype(np.uint64)
    order = np.lexsort((values, groups))
    values, groups = values[order], groups[order]
    got = [(i, j) for a, b in simhash.trie_pairs(values, groups, 12, 2) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(i, j) for i in range(900) for j in range(i + 1, 900) if groups[i] == groups[j] and bin(int(values[i] ^ values[j])).count("1") <= 2]
    assert sorted(got) == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7), (5, 6)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp int, component_id string"
    docs = spark.createDataFrame([(5, None, 1, "a"), (None, "", 1, "b"), (3, " ", 1, "c"), (9, "a b c d", 1, "d"), (9, "a b c d", 1, "d"), (None, "x y z w", 2, "e")], schema)
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 3), (3, 3), (5, 3), (9, 9), (9, 9)]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_near_copies_of_the_pipeline_stage(spark):
    """Classes by five-word Jaccard similarity of 0.8, against all pairs; most near copies differ by more than three bits."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    docs = []
    for size in (30, 60, 200, 400) * 4:
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        docs.append(base)
        for edits in (1, size // 60, size // 40, size // 20):
            new = list(base)
            for at in rng.choice(size, edits, replace=False):
                new[at] = f"v{rng.integers(0, 5000)}"
            docs.append(new)
    texts = {i: " ".join(d) for i, d in enumerate(docs)} | {900: "", 901: " ", 902: "a b c", 903: "A  b c"}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for d, t in texts.items()}
    root = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()
    assert len(set(root.values())) < len(texts) - 20
    assert sorted(r["doc_id"] for r in got) == sorted(set(root.values()))


def test_crowded_bands_meet_block_by_block(spark):
    """One family of near copies and one of texts that share only a third: the same classes whole and in blocks."""
    rng = np.random.default_rng(4)
    shared = [f"s{x}" for x in range(60)]
    texts = []
    for i in range(120):
        own = list(shared) + [f"o{i}_{x}" for x in range(60)] if i % 2 else shared * 1 + [f"f{x}" for x in range(60)]
        if not i % 2:
            own[int(rng.integers(0, 120))] = f"e{i}"
        texts.append((i, " ".join(own)))
    sets = {d: simhash.shingles(t, 5) for d, t in texts}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for crowd in (4096, 10):
        fps, edges = simhash.similar_links(docs, 5, 0.8, crowd)
        rows = fps.join(simhash.classes(fps, edges=edges), "fp").collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == root


def test_unlike_members_of_one_band_take_bounded_time():
    """3,000 sets that share a third of their shingles, none linked."""
    import time

    rng = np.random.default_rng(6)
    shared = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 60, dtype=np.uint64)])) for _ in range(3000)]
    begin = time.monotonic()
    root = simhash.similar_stars(sets, np.zeros(len(sets), np.int64), 0.8)
    assert (root == np.arange(len(sets))).all() and time.monotonic() - begin < 60
