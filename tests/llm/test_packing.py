import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from runweave.llm import packing
from runweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, length string, rank int"
TEXTS = [None, "", "one", "one", "a b c " * 700, "é ñ ß " * 900, "x" * 9000, "tail <|endoftext|> here", "日本語 text", "tab\tand\x1f\xa0blank  end "]


@pytest.fixture(scope="module")
def packed(spark):
    docs = spark.createDataFrame([(i % 8, t, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    return [r.asDict() for r in packing.pack(docs, tokenizer_path(), with_ids=True).collect()]


def test_ids_are_the_tokenizers_own(packed):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    want = sorted((i % 8, own.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in enumerate(TEXTS))
    got = defaultdict(list)
    for r in packed:
        assert len(r["ids"]) == r["length"] <= 1024 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 1024
        got[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    for doc_id in range(8):
        texts = sorted(ids for d, ids in want if d == doc_id)
        if len(texts) == 1:
            assert [x for _, start, ids in sorted(got[doc_id]) for x in ids] == texts[0]
            assert [start for _, start, _ in sorted(got[doc_id])] == np.cumsum([0] + [len(ids) for _, _, ids in sorted(got[doc_id])])[:-1].tolist()
        else:
            assert sum(len(ids) for _, _, ids in got[doc_id]) == sum(map(len, texts))


def test_sequences_are_gapless_and_within_capacity(packed):
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table_gives_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_takes_every_item_once_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(3000):
        counts[rng.choice([rng.randint(1, 1024), rng.randint(1, 200), 1024])] += 1
    used, bins = defaultdict(int), 0
    for n, items in packing.plan(dict(counts)):
        assert sum(items) <= 1024 and sum(x > 341 for x in items) <= 2 and n > 0
        bins += n
        for x in items:
            used[x] += n
    assert dict(used) == dict(counts)
    assert bins <= 1.02 * sum(k * n for k, n in counts.items()) / 1024 + sum(n for k, n in counts.items() if k > 512) * 0.03 + 2


def test_slots_hold_each_place_once():
    counts = {700: 5, 324: 3, 100: 40, 1024: 2}
    patterns = packing.plan(counts)
    places = set()
    for n, (start, first, at) in packing.slots(patterns).items():
        for rank in range(counts[n]):
            run = np.searchsorted(start, rank, "right") - 1
            place = (int(first[run] + rank - start[run]), int(at[run]))
            assert place not in places
            places.add(place)
    assert len(places) == sum(counts.values())


def test_query_packs_the_whole_table(spark):
    import __spark_entry__ as e

    rows = e.queries()["op1_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len({r["doc_id"] for r in rows}) == docs
    total, bins = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert bins <= -(-total // 1024) + 1
    json.dumps([r.asDict() for r in rows[:3]])
