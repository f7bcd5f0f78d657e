"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into passages of at most ``PASSAGE`` words; their TF-IDF rows (document
frequencies from the whole corpus) get a randomised SVD, whose products with the matrix run as
Spark aggregates. Overlapping windows of every document are projected, and those whose cosine to a
passage reaches ``COSINE`` are its candidates. Candidates are checked word by word: a longest common
subsequence of most of the passage (``need_of``: 80 % of a short one, falling towards half of a long one, so
that rewording is found where chance can't explain it) within a span not much longer than it, and
``ANSWER`` of the answer's words (a text's last words, or what follows its last question mark, and its
rarest words). A text is leaked into a document if one of its passages is.

A passage's window is at most twice as long as the passage (longer only for the shortest), and the rank
is at least a block's number of passages, so no passage lies outside of the latent space.

Results by case: null, empty and very short benchmark texts (under ``LEAST`` words) match nothing, nor do those
without an id; equal texts match alike under each id; a null or empty document is clean; repeated documents get
equal results; an empty table gives an empty result, an empty benchmark finds every document clean; extra columns are
not read. The benchmark is taken in groups of ``GROUP`` passages, one pass over the documents each, so
what is broadcast is bounded at any benchmark size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name

#: Passages of one SVD, and of one pass over the documents.
PASSAGE, LEAST, BLOCK, GROUP = 64, 5, 256, 1024
#: Dimensions kept, extra ones drawn, and power iterations of the SVD.
RANK, OVERSAMPLE, POWER = 256, 16, 2
#: Cosine of a window and a passage from which the window is a candidate.
COSINE = 0.4
#: Share of a passage's words in order; long passages need a half and ``BEYOND`` words only. Share of its answer's words.
SHARE, BEYOND, ANSWER = 0.8, 2, 0.4
#: A word counts in a window only if it doesn't stand among the so many words before it, so that repeats don't outweigh a passage.
REPEAT = 32
#: Words of documents put together, positions handled in one array, and the words that window borders are multiples of.
CHUNK, PIECE, BASE = 1 << 18, 3 << 13, 6

#: A-Z to lower case, ASCII signs and control characters to blanks, all other bytes as they are.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and other characters between blanks and signs."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class Passage:
    item: int
    words: list[bytes]
    answer: frozenset[bytes]


def passages(items: list[tuple[int, str | None]]) -> list[Passage]:
    out = []
    for item, text in items:
        own = words_of(text)
        if len(own) < LEAST:
            continue
        asked = (text or "").rpartition("?")
        tail = words_of(asked[2]) if asked[1] else []
        tail = tail or own[-max(3, len(own) // 8) :]
        pieces = -(-len(own) // PASSAGE)
        for i in range(pieces):
            part = own[len(own) * i // pieces : len(own) * (i + 1) // pieces]
            out.append(Passage(item, part, frozenset(tail) & frozenset(part)))
    return out


def span_of(words: int) -> int:
    """Words among which a passage of ``words`` may be spread."""
    return words + words // 4 + 2


def need_of(words: int) -> int:
    """Words of a passage of ``words`` that must stand in order."""
    return min(-(-int(round(SHARE * words * 1000)) // 1000), words // 2 + words % 2 + BEYOND)


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents, over the whole table."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, met, n = frozenset(shared.value), Counter(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(i, 256).to_pylist()
                n += len(texts)
                for t in texts:
                    met.update(terms.intersection(words_of(t)))
        own = np.zeros(len(shared.value) + 1, np.int64)
        for w, k in met.items():
            own[shared.value[w]] = k
        own[0] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(own)], names=["term", "n"])

    rows = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out, int(out[0])


def randomised_svd(matrix: DataFrame, width: int, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (width, rank) of sparse rows ``terms, weights``.

    Each step multiplies a thin matrix by the rows and their transpose in one pass: tasks sum up
    their rows' shares term by term, and an aggregate adds the tasks' sums.
    """
    spark, size = matrix.sparkSession, min(rank + OVERSAMPLE, width)
    names = [f"v{j}" for j in range(size)]

    def product(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shared.value.shape)
            for batch in batches:
                for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = np.array(weights)
                    out[terms] += w[:, None] * (w @ shared.value[terms])
            used = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c) for c in out[used].T)], names=["term", *names])

        got = matrix.select("terms", "weights").mapInArrow(multiplied, "term long, " + ", ".join(f"{n} double" for n in names)).groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        out = np.zeros((width, size))
        out[got["term"].to_numpy()] = np.stack([got[n].to_numpy() for n in names], 1) if got.num_rows else 0
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(product(q))[0]
    small = q.T @ product(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(), 1e-300)]
    return q @ vectors[:, keep]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each of ``a``'s words."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        if m := places.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def without_repeats(ids: np.ndarray) -> np.ndarray:
    """``ids`` with 0 in place of each that stands within ``REPEAT`` places before it."""
    order = np.argsort(ids, kind="stable")
    again = (ids[order[1:]] == ids[order[:-1]]) & (order[1:] - order[:-1] <= REPEAT)
    out = ids.copy()
    out[order[1:][again]] = 0
    return out


@dataclass
class Index:
    """What a task needs to search windows: bounded by ``BLOCK`` passages of ``PASSAGE`` words."""

    #: The block's number of each of the group's terms, 0 for those that the block lacks.
    local: np.ndarray
    latent: np.ndarray
    found: np.ndarray
    passages: list[tuple[int, list[int], frozenset[int]]]

    def __post_init__(self) -> None:
        self.terms = [frozenset(own) for _, own, _ in self.passages]
        self.need = np.array([need_of(len(own)) for _, own, _ in self.passages])
        self.span = np.array([span_of(len(own)) for _, own, _ in self.passages])
        self.holds = np.zeros((len(self.passages), len(self.latent)), bool)
        for i, own in enumerate(self.terms):
            self.holds[i, list(own)] = True
        # Windows begin at every step and are three steps long: a span of at most two steps lies in one of them.
        steps = -(-self.span // (2 * BASE)) * BASE
        self.classes = [(int(s), np.flatnonzero(steps == s)) for s in np.unique(steps)]

    def accepts(self, which: int, around: list[int]) -> bool:
        """Whether the words ``around`` hold the passage, nearly in order and nearly without gaps."""
        _, own, answer = self.passages[which]
        terms, need, span = self.terms[which], self.need[which], self.span[which]
        known = [(i, w) for i, w in enumerate(around) if w in terms]
        begin = 0
        for end in range(len(known)):  # known words within one span, its last at ``end``
            while known[end][0] - known[begin][0] >= span:
                begin += 1
            if end - begin + 1 >= need and (end + 1 == len(known) or known[end + 1][0] - known[begin][0] >= span):
                part = [w for _, w in known[begin : end + 1]]
                if len(answer & set(part)) >= ANSWER * len(answer) and common_subsequence(own, part) >= need:
                    return True
        return False

    def candidates(self, flat: np.ndarray, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Windows of ``flat`` from ``begin`` on, and the passages they are near to, the nearest first; by length of window."""
        widest = 3 * self.classes[-1][0]
        part = flat[begin : begin + PIECE + widest]
        part = np.concatenate([part, np.zeros(-len(part) % BASE, part.dtype)])
        if not part.any():
            return
        fresh = without_repeats(part)
        sums = self.latent.take(fresh[::BASE], axis=0, mode="clip")
        row = np.empty_like(sums)
        for i in range(1, BASE):
            sums += self.latent.take(fresh[i::BASE], axis=0, out=row, mode="clip")
        total = np.concatenate([np.zeros((1, sums.shape[1]), sums.dtype), np.cumsum(sums, axis=0)])
        known = np.concatenate([[0], np.cumsum(part > 0)])
        for step, members in self.classes:
            starts = np.arange(0, min(PIECE, len(part)), step)
            ends = np.minimum(starts + 3 * step, len(part))
            some = known[ends] - known[starts] >= self.need[members].min()
            starts, ends, found = starts[some], ends[some], self.found[members].T
            for i in range(0, len(starts), 2048):
                vector = total[ends[i : i + 2048] // BASE] - total[starts[i : i + 2048] // BASE]
                length = np.sqrt(np.einsum("ij,ij->i", vector, vector))
                cosine = (vector @ found) / np.maximum(length, 1e-6)[:, None]
                row, of = np.nonzero(cosine >= COSINE)
                order = np.argsort(-cosine[row, of], kind="stable")
                yield begin + starts[i + row[order]], members[of[order]], 3 * step

    def search(self, texts: list[list[int]]) -> list[set[int]]:
        """The leaked items of each text, given as the group's term numbers."""
        out: list[set[int]] = [set() for _ in texts]
        gap = 3 * self.classes[-1][0]  # no window meets two texts
        flat = np.zeros(sum(map(len, texts)) + gap * (len(texts) + 1), np.int64)
        ends, at = [], gap
        for t in texts:
            flat[at : at + len(t)] = t
            ends.append(at + len(t))
            at += len(t) + gap
        flat = self.local[flat]
        for begin in range(0, len(flat), PIECE):
            for places, which, width in self.candidates(flat, begin):
                for i in range(0, len(places), 4096):
                    p = which[i : i + 4096]
                    ids = flat[np.minimum(places[i : i + 4096, None] + np.arange(width), len(flat) - 1)]
                    enough = np.flatnonzero(self.holds[p[:, None], ids].sum(1) >= self.need[p])  # at least the common subsequence
                    owner = np.searchsorted(ends, places[i + enough])
                    for w, of, row in zip(p[enough].tolist(), owner.tolist(), ids[enough], strict=True):
                        if self.passages[w][0] not in out[of] and self.accepts(w, row.tolist()):
                            out[of].add(self.passages[w][0])
        return out


@dataclass
class Group:
    """The blocks searched in one pass, and the numbers of their words."""

    vocabulary: dict[bytes, int]
    blocks: list[Index]

    def ids(self, text: str | None) -> list[int]:
        """Term numbers of a text's words (0: none)."""
        get = self.vocabulary.get
        return [get(w, 0) for w in words_of(text)]

    def search(self, texts: list[list[int]]) -> list[set[int]]:
        found = [block.search(texts) for block in self.blocks]
        return [set().union(*each) for each in zip(*found, strict=True)]


def build_block(spark: SparkSession, block: list[Passage], vocabulary: dict[bytes, int], idf: np.ndarray) -> Index:
    own = np.array(sorted({vocabulary[w] for p in block for w in p.words}))
    local = np.zeros(len(vocabulary) + 1, np.uint16 if len(own) < 1 << 16 else np.int32)
    local[own] = np.arange(1, len(own) + 1)
    weight = np.concatenate([[0.0], idf[own]])
    rows, kept = [], []
    for p in block:
        ids = [int(local[vocabulary[w]]) for w in p.words]
        terms = sorted(set(ids))
        rows.append((terms, weight[terms].tolist()))
        rare = sorted(terms, key=lambda t: (-weight[t], t))[:3]
        kept.append((p.item, ids, frozenset(int(local[vocabulary[w]]) for w in p.answer) | frozenset(rare)))
    matrix = spark.createDataFrame(rows, "terms array<long>, weights array<double>")
    basis = randomised_svd(cut(matrix, "passages"), len(weight), min(RANK, len(block)))
    found = np.zeros((len(rows), basis.shape[1]))
    for i, (terms, weights) in enumerate(rows):
        found[i] = np.array(weights) @ basis[terms]
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return Index(local, (weight[:, None] * basis).astype(np.float32), found.astype(np.float32), kept)


def build_group(docs: DataFrame, group: list[Passage]) -> Group:
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for p in group for w in p.words}))}
    df, n = document_frequencies(docs, vocabulary)
    idf = np.log((n + 1) / (df + 1.0)) + 0.05
    return Group(vocabulary, [build_block(docs.sparkSession, group[i : i + BLOCK], vocabulary, idf) for i in range(0, len(group), BLOCK)])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the array of leaked items in a last column, ``item_ids`` (underscores added if the name is taken)."""
    spark, name = docs.sparkSession, free_name(docs, "item_ids")
    names, at = docs.columns, docs.columns.index("text")
    out = docs.withColumn(name, F.array().cast("array<long>"))
    seen: list[Passage] = []

    def searched(df: DataFrame, group: list[Passage]) -> DataFrame:
        shared = spark.sparkContext.broadcast(build_group(docs, group))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                held = batch.column(len(names)).to_pylist()
                begin, texts, size = 0, [], 0
                for i, raw in enumerate(batch.column(at)):
                    texts.append(index.ids(raw.as_py()))
                    size += len(texts[-1]) + 2 * PASSAGE
                    if size >= CHUNK or i == batch.num_rows - 1:
                        part = batch.slice(begin, i + 1 - begin)
                        both = [sorted(x | set(h or ())) for x, h in zip(index.search(texts), held[begin : i + 1], strict=True)]
                        yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(both, pa.list_(pa.int64()))], names=[*names, name])
                        begin, texts, size = i + 1, [], 0

        return df.mapInArrow(found, out.schema)

    for row in benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), "text").toLocalIterator():
        seen += passages([(row[0], row[1])])
        if len(seen) >= GROUP:
            out, seen = searched(out, seen), []
    return searched(out, seen) if seen else out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no benchmark text leaked."""
    name = free_name(docs, "item_ids")
    return leaks(docs, benchmark).where(F.size(name) == 0).drop(name)
