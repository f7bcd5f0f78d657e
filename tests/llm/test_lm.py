import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runweave.llm import lm

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def in_training(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


class PlainModel:
    """Prediction by partial matching, one symbol at a time, from dictionaries."""

    def __init__(self, texts, order, least):
        self.order = order
        self.all = [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            s = [256] * order + list((t or "").encode()) + [256]
            for i in range(order, len(s)):
                for j in range(order + 1):
                    self.all[j][tuple(s[i - j : i])][s[i]] += 1
        self.kept = [{c: {x: n for x, n in own.items() if n >= least} for c, own in level.items()} for level in self.all]

    def p(self, context, symbol):
        p, out = 1.0, set()
        for j in range(self.order, -1, -1):
            c = tuple(context[len(context) - j :])
            own = self.kept[j].get(c)
            if not own:
                continue
            open_ = {x: n for x, n in own.items() if x not in out}
            escape = len(open_) + sum(self.all[j][c].values()) - sum(own.values())
            whole = sum(open_.values()) + escape
            if symbol in open_:
                return p * open_[symbol] / whole
            if escape:
                p *= escape / whole
            out = set(own)
        return p / (257 - len(out))

    def log10(self, text):
        s = [256] * self.order + list((text or "").encode()) + [256]
        return sum(math.log10(self.p(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def check(rows, docs, order, least, hot_total=None):
    train = [t for d, t in docs if in_training(d)]
    c = Counter(w for t in train for w in words_of(t))
    n, v = sum(c.values()), len(c)
    model = PlainModel(train, order, least)
    assert len(rows) == len(docs)
    want = defaultdict(list)
    for d, t in docs:
        own = words_of(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[d].append((base, len(own), sum(c[w] > 0 for w in own), not in_training(d), n, model.log10(t)))
    for r in rows:
        best = min(want[r["doc_id"]], key=lambda x: abs(x[0] - r["base_score"]))
        assert (r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"]) == best[1:5]
        assert r["base_score"] == pytest.approx(best[0], rel=1e-9) and r["score"] == pytest.approx(best[5], rel=1e-9)


def test_query_against_brute_force(spark):
    import __spark_entry__ as e

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(e.queries()["op4_lm_scoring"](spark, SF).collect(), docs, lm.ORDER, 1)


@pytest.mark.parametrize("order,share,hot", [(2, 0.01, 20), (3, 0.001, 1)])
def test_pruned_trie_and_joined_words(spark, order, share, hot):
    docs = [(i, t) for i, t in enumerate(["The cat sat. ", "the Dog sat é", "", None, "the the the cat " * 30, "zebra\x00 quartz", "a b c d e f", "the cat"])] + [(None, "null id"), (4, "the the the cat " * 30)]
    rows = lm.score_texts(spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double"), order=order, share=share, hot_words=hot).collect()
    symbols = sum(len((t or "").encode()) + 1 for d, t in docs if in_training(d))
    check(rows, docs, order, max(1, math.ceil(symbols * share)))


def test_probabilities_sum_to_one():
    model_texts = [b"abracadabra", b"abba", b"cab"]
    counter = lm.GramCounter()
    for gram, _ in lm.grams(model_texts, 2):
        counter.add(gram)
    keys, n = counter.items()
    nodes, totals = [], []
    for j in range(3):
        low, back = np.unique(keys & np.uint64((1 << 9 * (j + 1)) - 1), return_inverse=True)
        m = np.bincount(back, n).astype(np.int64)
        ctx, at = np.unique(low >> np.uint64(9), return_inverse=True)
        totals.append((ctx, np.bincount(at, m)))
        nodes.append((low[m >= 2], m[m >= 2]))
    trie = lm.Trie(nodes, totals)
    for context in (b"ab", b"ca", b"zz", b"ba"):
        base = context[0] << 18 | context[1] << 9
        assert (10 ** trie.log10(np.array([base | s for s in range(257)], np.uint64))).sum() == pytest.approx(1)


def test_texts_longer_than_a_chunk(monkeypatch):
    whole = [g for g, _ in lm.grams([b"abcdefgh" * 40, b"", b"xyz"], 3)][0]
    monkeypatch.setattr(lm, "CHUNK", 50)
    parts = list(lm.grams([b"abcdefgh" * 40, b"", b"xyz"], 3))
    assert len(parts) > 3 and np.concatenate([g for g, _ in parts]).tolist() == whole.tolist()
    assert np.bincount(np.concatenate([o for _, o in parts])).tolist() == [321, 1, 4]


def test_crowded_slots(monkeypatch):
    monkeypatch.setattr(lm, "SLOTS_LOG2", 3)
    counter, rng = lm.GramCounter(), np.random.default_rng(0)
    data = [rng.integers(0, 50, 200).astype(np.uint64) for _ in range(70)]
    for d in data:
        counter.add(d)
    keys, n = counter.items()
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(Counter(np.concatenate(data).tolist())) and len(set(keys.tolist())) == len(keys)


def test_empty_table_and_no_training_rows(spark):
    schema = "doc_id long, text string"
    assert lm.score_texts(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if not in_training(i))
    row = lm.score_texts(spark.createDataFrame([(held, "ab")], schema)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] == pytest.approx(-3 * math.log10(257))


def test_rare_grams_keep_their_contexts(spark, monkeypatch):
    """Above two million symbols nothing is pruned either; many small chunks and buckets."""
    monkeypatch.setattr(lm, "ROWS", 50, raising=False)
    monkeypatch.setattr(lm, "PIECE", 1 << 18, raising=False)
    rng = np.random.default_rng(4)
    often = "".join(rng.choice(list("abc "), 500))
    docs = [(i, often * 20) for i in range(300)] + [(1000 + i, f"quixotic zephyr {i * 7919} {often[:30]}") for i in range(30)]
    texts = [t for d, t in docs if in_training(d)]
    assert sum(len(t) + 1 for t in texts) > 2_100_000
    rows = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).where("doc_id >= 1000").collect()}
    grams = Counter(g for t in texts for s in [[256] * 4 + list(t.encode()) + [256]] for g in zip(*(s[j:] for j in range(5)), strict=False))
    model = PlainModel([], 4, 1)
    for g, n in grams.items():
        for j in range(5):
            model.all[j][g[4 - j : 4]][g[4]] += n
    model.kept = model.all
    assert len(rows) == 30
    for d, t in docs[300:]:
        assert rows[d] == pytest.approx(model.log10(t), rel=1e-9)
