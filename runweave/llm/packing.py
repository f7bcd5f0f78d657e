"""Best-fit packing of token pieces into sequences, large items matched first.

``tokenize`` cuts every text into pieces of at most ``capacity`` ids. ``plan`` packs piece
*lengths*: there are at most ``capacity`` different ones, so their counts fit on the driver at
any corpus size, and all bins of one pattern are handled together. Items above a third of the
capacity go at most twice into a bin: taken from the largest down, each is matched with the
largest other one that still fits. Smaller items, largest first, fill the smallest gap that
takes them, and open a bin where none does. ``place`` gives each piece its place by its rank
among the pieces of its length; ranks are counted in salted groups, so a length that holds a third of all
pieces is no single group.

Results by case: a null or empty text is one piece, the end id alone; equal rows are packed as
often as they occur; ties in length go by id, then piece; an empty table gives an empty result;
other columns of the input are not read; a longer text is cut so that only its first piece
may be short.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 1024
END_ID = 2
#: Pieces in one salted group of a length, about; groups grow in number, not in size.
GROUP = 2_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to id lists, equal to the tokenizer file's own results.

    The file's merges run in the faster library where both are known to split alike: plain
    letters, digits and marks below U+0250. Other texts, and those that spell a special token,
    go through the file's own tokenizer.
    """
    import os

    import regex
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = _byte_letters(), [a["content"] for a in spec.get("added_tokens", ())]
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("pieces", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    odd = regex.compile("|".join(["[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\u024f]", *map(regex.escape, special)]))

    def encode(texts: list[str]) -> list[list[int]]:
        return [own.encode(t, add_special_tokens=False).ids if odd.search(t) else fast.encode_ordinary(t) for t in texts]

    return encode


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of each document; ``with_ids`` adds the ids themselves."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, kept = [], []
                for key, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    flat = np.array([*ids, end_id], "<u4")
                    first = (len(flat) - 1) % capacity + 1
                    for k, begin in enumerate([0, *range(first, len(flat), capacity)]):
                        own = flat[begin : first if k == 0 else begin + capacity]
                        rows.append((key, k, begin, len(own), zlib.crc32(own.tobytes())))
                        if with_ids:
                            kept.append(own.astype(np.int32))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``[(bins, item lengths in a bin)]`` for ``counts`` of items by length."""
    left, large = {n: c for n, c in counts.items() if c > 0}, capacity // 3
    done: list[tuple[int, tuple[int, ...]]] = []
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)

    def keep(bins: int, items: tuple[int, ...], gap: int) -> None:
        if bins and gap:
            gaps[gap].append((bins, items))
        elif bins:
            done.append((bins, items))

    big = sorted((n for n in left if n > large), reverse=True)
    for n in big:
        while left[n]:
            mate = next((m for m in big if m <= capacity - n and left[m] > (m == n)), None)
            if mate is None:
                keep(left[n], (n,), capacity - n)
                left[n] = 0
            else:
                bins = left[n] // 2 if mate == n else min(left[n], left[mate])
                keep(bins, (n, mate), capacity - n - mate)
                left[n] -= bins
                left[mate] -= bins
    for n in sorted((n for n in left if n <= large), reverse=True):
        while left[n]:
            gap = min((g for g, own in gaps.items() if g >= n and own), default=None)
            if gap is None:
                per = capacity // n
                full, rest = divmod(left[n], per)
                keep(full, (n,) * per, capacity - n * per)
                keep(1 if rest else 0, (n,) * rest, capacity - n * rest)
                left[n] = 0
                break
            bins, items = gaps[gap].pop()
            per = gap // n
            full = min(bins, left[n] // per)
            rest = left[n] - full * per if full < bins else 0
            keep(full, items + (n,) * per, gap - n * per)
            if full < bins and rest:
                keep(1, items + (n,) * rest, gap - n * rest)
            keep(bins - full - (1 if rest else 0), items, gap)
            left[n] -= full * per + rest
    return [(bins, list(items)) for bins, items in [*done, *(x for own in gaps.values() for x in own)]]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of slots, its first bin and its offset in the bin."""
    runs, used, first = defaultdict(list), defaultdict(int), 0
    for bins, items in patterns:
        offset = 0
        for n in items:
            runs[n].append((used[n], first, offset))
            used[n] += bins
            offset += n
        first += bins
    return {n: tuple(np.array(c, np.int64) for c in zip(*own, strict=True)) for n, own in runs.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; read twice, so give a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    groups = F.create_map(*[F.lit(int(x)) for n, c in counts.items() for x in (n, c // GROUP + 1)]) if counts else F.create_map(F.lit(0), F.lit(1))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups[F.col("length").cast("int")]))
    tally = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = tally.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before") - 1).drop("salt", "before")
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join([f"`{n}` {t}" for n, t in ranked.dtypes if n != "rank"] + ["sequence_id long", "offset long"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            bin_, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own, (start, first, at) = length == n, where.value[int(n)]
                run = np.searchsorted(start, rank[own], "right") - 1
                bin_[own], offset[own] = first[run] + rank[own] - start[run], at[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(bin_), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place in it."""
    return place(cut(tokenize(docs, path, capacity, end_id, with_ids), "pieces"), capacity)
