"""Exact top-k by inner product, block at a time.

Vectors are made whole numbers and stored in blocks, one matrix each, with the largest and least
value of every dimension (term). Blocks are ranges of an order in which near vectors are near: by
cells of a k-means fitted to at most ``FIT_ROWS`` rows, cells in the order of their centres along the
leading direction. For each query the sum over terms of the larger of weight times largest and
weight times least bounds any score in the block. Blocks are taken in the order of that bound and
scored through their matrix until no remaining bound reaches the query's kth score so far. Blocks
are dealt to shards. A query first visits the shard that holds its own row; the kth score found
there goes along to all shards, which hand back only what reaches it, and the best of that are
ranked. Work, not results, depends on the cells: how much is pruned is up to how the vectors lie.

Results by case: vectors that are null, or hold a null or a non-finite component, take no part;
shorter vectors count as followed by zeros; ties go to the smaller id; rows repeated under one id
are queries and candidates of their own, and a query leaves out its own row alone; a null id
takes no part; an empty table, or one without a query, gives an empty result; other columns
are not read. Sums are exact while they fit a long; beyond, the job fails rather than round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
#: Rows of a block, blocks of a shard, queries handed over together.
BLOCK, SHARD, BATCH = 64, 128, 256
#: Rows that the cells are fitted to at most, cells at most, and rounds of k-means.
FIT_ROWS, CELLS, ROUNDS = 8192, 256, 6
_NONE = np.iinfo(np.int64).min


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, v`` (floor(scale * x), x as double) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(sound).select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), ends)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(ends) - ends, ends)] = values
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; through doubles where every sum is exact there."""
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if top < 2**52:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    return np.array(a.astype(object) @ b.astype(object).T).astype(np.int64)  # raises if a sum leaves the long


class Shard:
    """Blocks of candidates in the given order, with the extremes of their terms. ``scored`` counts inner products."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.blocks = [(ids[i : i + BLOCK], rows[i : i + BLOCK], vectors[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
        self.high = np.array([v.max(0) for _, _, v in self.blocks], float)
        self.low = np.array([v.min(0) for _, _, v in self.blocks], float)
        self.scored = 0

    def best(self, rows: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and candidate ids (queries, k), best first, of those that reach the query's ``least`` score; else the least long."""
        q = queries.astype(float)
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        bound += np.abs(bound) * 1e-9 + 1  # never under the exact bound
        turn = np.empty(bound.shape, np.int64)
        np.put_along_axis(turn, np.argsort(-bound, axis=1, kind="stable"), np.arange(len(self.blocks))[None, :], 1)
        top, who = np.full((len(rows), k), _NONE), np.full((len(rows), k), np.iinfo(np.int64).max)
        begin, end = 0, 1
        while begin < len(self.blocks):  # each query's blocks by their bounds: the first, the next two, the next four...
            reach = bound >= np.maximum(top[:, -1:], least[:, None])
            now = reach & (turn >= begin) & (turn < end)
            for b in np.flatnonzero(now.any(0)):
                mine = np.flatnonzero(now[:, b])
                mine = mine[bound[mine, b] >= top[mine, -1]]
                if not len(mine):
                    continue
                names, own, vectors = self.blocks[b]
                self.scored += len(mine) * len(names)
                score = _product(queries[mine], vectors)
                score[(rows[mine][:, None] == own[None, :]) | (score < least[mine][:, None])] = _NONE
                score = np.concatenate([top[mine], score], 1)
                ids = np.concatenate([who[mine], np.broadcast_to(names, (len(mine), len(names)))], 1)
                ids[score == _NONE] = np.iinfo(np.int64).max
                first = np.lexsort((ids, -1 - score), axis=1)[:, :k]
                top[mine], who[mine] = np.take_along_axis(score, first, 1), np.take_along_axis(ids, first, 1)
            if not (reach & (turn >= end)).any():
                break
            begin, end = end, 2 * end + 1
        return top, who


def fit_cells(sample: np.ndarray, cells: int = CELLS, seed: int = 3) -> np.ndarray:
    """Centres (at most ``cells``, one for each 32 rows) by k-means, in the order of their leading direction."""
    sample = sample.astype(float)
    if not len(sample) or not sample.shape[1]:
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, max(1, len(sample) // 32)), replace=False)]
    for _ in range(ROUNDS):
        cell = nearest(sample, centres)
        count = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    middle = centres - centres.mean(0)
    return centres[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * vectors.astype(float) @ centres.T, axis=1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products with other rows. ``is_query`` reads the column ``id``."""
    spark = vectors.sparkSession
    table = cut(integers(vectors, vec_id, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    facts = table.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width, shards = facts["width"] or 0, max(1, -(-facts["n"] // (BLOCK * SHARD)))
    bar = min(1.0, 0.9 * FIT_ROWS / max(1, facts["n"]))
    sample = table.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(bar * (1 << 30))).limit(FIT_ROWS).select("v").toArrow()
    centres = spark.sparkContext.broadcast(fit_cells(_matrix(sample.column("v").combine_chunks(), width)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = nearest(_matrix(batch.column(1), width), centres.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=["id", "v", "row", "cell"])

    cells = table.select("id", "v", "row").mapInArrow(placed, "id long, v array<long>, row long, cell long")
    ranged = cut(cells.repartitionByRange(shards, "cell", "v", "row").withColumn("shard", F.spark_partition_id()), "ranged")
    last = ranged.agg(F.max("shard")).first()[0] or 0
    held = ranged.select("shard", F.lit(0).alias("turn"), "id", "row", "v", F.lit(None).cast("long").alias("least"), "cell")

    def searched(seeds: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A shard's candidates come first, in order, and are kept; its queries stream by."""
            at, parts, own = None, [], None
            for batch in batches:
                shard, turn, ids, rows, v, least = (batch.column(i) for i in range(6))
                steps = np.flatnonzero(np.diff(shard.to_numpy() * 2 + turn.to_numpy())) + 1
                for begin, end in zip([0, *steps], [*steps, batch.num_rows], strict=True):
                    if shard[int(begin)].as_py() != at:
                        at, parts, own = shard[int(begin)].as_py(), [], None
                    names, marks, lists = (c.slice(begin, end - begin) for c in (ids, rows, v))
                    if turn[int(begin)].as_py() == 0:
                        parts.append((names.to_numpy(), marks.to_numpy(), _matrix(lists, width)))
                        continue
                    if own is None and parts:
                        own = Shard(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    bars = least.slice(begin, end - begin).fill_null(_NONE).to_numpy()
                    for i in range(0, len(names) if own else 0, BATCH):
                        mine = marks.slice(i, BATCH).to_numpy()
                        top, who = own.best(mine, _matrix(lists.slice(i, BATCH), width), bars[i : i + BATCH], k)
                        q, place = np.nonzero(top[:, -1:] != _NONE) if seeds else np.nonzero(top != _NONE)
                        cols = [names.slice(i, BATCH).to_numpy()[q], mine[q], who[q, place], top[q, -1 if seeds else place]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "row", "vec_id", "score"])

        return run

    def visited(asked: DataFrame, seeds: bool) -> DataFrame:
        dealt = held.unionByName(asked.select("shard", F.lit(1).alias("turn"), "id", "row", "v", "least", F.lit(0).cast("long").alias("cell")))
        sorted_ = dealt.repartition(last + 1, "shard").sortWithinPartitions("shard", "turn", "cell", "v", "row")
        return sorted_.mapInArrow(searched(seeds), "query_id long, row long, vec_id long, score long")

    asked = ranged.where(is_query).withColumn("least", F.lit(None).cast("long"))
    seeds = cut(visited(asked, True).select("row", F.col("score").alias("least")), "seeds")
    # Every query visits every shard: that is the stated query set against all rows, in blocks.
    every = asked.drop("least", "shard").join(seeds, "row", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return visited(every, False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
