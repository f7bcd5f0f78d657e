"""Language-model scores: a word unigram base and prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes, counted over every training text. A
symbol is looked for from the longest known context down; where a context lacks it, the code
pays that context's escape (the share of its distinct symbols and of its rare mass) and goes
on one byte shorter, with the symbols of the longer context excluded; below the empty context
the remaining symbols are equally likely. Texts start after, and end with, symbol 256.

Counting is distributed: the rows are taken in chunks of about ``PIECE`` bytes, each of which names its distinct
(context, symbol) grams of full length and how often training texts hold them. One shuffle adds these
up, and brings each gram to the bucket of its last ``NEAR`` context symbols, where all counts of the contexts
that end so are; shorter contexts have 257 ** (NEAR + 1) nodes at most in any corpus and are broadcast. Buckets
give each chunk's grams their values, and these meet the chunk's texts. Every counted node is kept
(``share`` prunes those that fewer than that part of the training symbols reach, into their
context's escape). Words that make up 1 / HOT_WORDS of all tokens, which are HOT_WORDS at most, are looked
up in a broadcast table; all other words meet their counts in a join.

Results by case: a null or empty text is the end token alone; repeated rows are scored and
counted as often as they occur; a null id is in the fold of the empty text; an empty table gives
an empty result; without training rows N and V are 0 and the model is uniform. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold

ORDER = 4
#: Context symbols that name a bucket, rows of buckets handled at a time, and bytes of texts in one chunk.
NEAR, ROWS, PIECE = 2, 1 << 19, 1 << 24
HOT_WORDS = 1_000_000
END = 256
SYMBOLS = 257
#: Symbols handled in one array, and slots of the table that remembers grams.
CHUNK, SLOTS_LOG2 = 1 << 19, 20
_EMPTY = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams of ``order + 1`` symbols (9 bits each, the predicted one lowest) and the texts they belong to, some at a time."""
    parts: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(parts)
        gram = np.zeros(len(flat) - order, np.uint64)
        for j in range(order + 1):
            gram = (gram << np.uint64(9)) | flat[j : len(flat) - order + j]
        sizes = np.array([len(p) for p in parts])
        keep = np.ones(len(flat), bool)
        begins = np.cumsum(sizes) - sizes
        for j in range(order):
            keep[begins + j] = False
        return gram[keep[order:]], np.repeat(np.array(owners), sizes - order)

    for i, raw in enumerate(texts):
        symbols = np.empty(len(raw) + order + 1, np.uint64)
        symbols[:order] = symbols[-1] = END
        symbols[order:-1] = np.frombuffer(raw, np.uint8)
        for at in range(0, len(raw) + 1, CHUNK):
            piece = symbols[at : at + CHUNK + order]
            if held + len(piece) > CHUNK + order and parts:
                yield flush()
                parts, owners, held = [], [], 0
            parts.append(piece)
            owners.append(i)
            held += len(piece)
    if parts:
        yield flush()


def _slot(gram: np.ndarray) -> np.ndarray:
    return ((gram * _MIX) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


class GramCounter:
    """Counts grams: most in a table of fixed slots, the others in sorted runs."""

    def __init__(self) -> None:
        self.keys = np.full(1 << SLOTS_LOG2, _EMPTY)
        self.counts = np.zeros(1 << SLOTS_LOG2, np.int64)
        self.over: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, gram: np.ndarray) -> None:
        slot = _slot(gram)
        hit = self.keys[slot] == gram
        self.counts += np.bincount(slot[hit], minlength=len(self.counts))
        if hit.all():
            return
        new, n = np.unique(gram[~hit], return_counts=True)
        at = _slot(new)
        free = np.flatnonzero(self.keys[at] == _EMPTY)
        free = free[np.unique(at[free], return_index=True)[1]]
        self.keys[at[free]], self.counts[at[free]] = new[free], n[free]
        rest = np.ones(len(new), bool)
        rest[free] = False
        if rest.any():
            self.over.append((new[rest], n[rest]))
            if len(self.over) > 64:
                self.over = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([k for k, _ in self.over]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in self.over]), len(keys)).astype(np.int64)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.keys != _EMPTY
        more = [self._merged()] if self.over else []
        return np.concatenate([self.keys[used], *(k for k, _ in more)]), np.concatenate([self.counts[used], *(n for _, n in more)])


class Trie:
    """Kept nodes by order: sorted grams with their counts, sorted contexts with what their escapes need."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        """``nodes[j]``: grams of j + 1 symbols and counts; ``totals[j]``: contexts of j symbols and all that followed them."""
        self.nodes, self.contexts = [], []
        for j, (gram, n) in enumerate(nodes):
            order = np.argsort(gram)
            gram, n = gram[order].astype(np.uint64), n[order].astype(float)
            context, first = np.unique(gram >> np.uint64(9), return_index=True)
            kept, distinct = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (n, np.ones(len(n))))
            by = np.argsort(totals[j][0])
            all_ = totals[j][1][by].astype(float)[np.searchsorted(totals[j][0][by].astype(np.uint64), context)] if len(context) else kept
            if j and len(gram):  # what the shorter context is left with once these symbols are excluded
                low, m = self.nodes[j - 1]
                less = np.add.reduceat(m[np.searchsorted(low, gram & np.uint64((1 << 9 * j) - 1))], first)
            else:
                less = np.zeros(len(context))
            self.nodes.append((gram, n))
            self.contexts.append((context, kept, distinct, all_ - kept, less))

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after the others."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        excluded, excluded_n = np.zeros(len(gram)), np.zeros(len(gram))
        for j in range(len(self.nodes) - 1, -1, -1):
            (keys, n), (context, kept, distinct, rare, less) = self.nodes[j], self.contexts[j]
            if not len(keys) or not len(open_):
                continue
            own = gram[open_] & np.uint64((1 << 9 * (j + 1)) - 1)
            at = np.minimum(np.searchsorted(context, own >> np.uint64(9)), len(context) - 1)
            known = context[at] == own >> np.uint64(9)
            node = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found = known & (keys[node] == own)
            escape = distinct[at] - excluded_n[open_] + rare[at]
            whole = kept[at] - excluded[open_] + escape
            share = np.where(found, n[node], np.where(escape > 0, escape, 1))
            out[open_] += np.where(known & (found | (escape > 0)), np.log10(share / np.where(whole > 0, whole, 1)), 0)
            excluded[open_] = np.where(known, less[at], excluded[open_])
            excluded_n[open_] = np.where(known, distinct[at], excluded_n[open_])
            open_ = open_[~found]
        out[open_] -= np.log10(SYMBOLS - excluded_n[open_])
        return out


class Values:
    """log10 probabilities of known grams, with the same lookup as a trie's."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.value = gram[order].astype(np.uint64), value[order]

    def log10(self, gram: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.gram, gram)
        assert len(self.gram) and (self.gram[np.minimum(at, len(self.gram) - 1)] == gram).all(), "a gram without a value"
        return self.value[at]


class Scorer:
    """Sums of log10 values over texts; grams met before are looked up by slot."""

    def __init__(self, trie: Trie | Values, order: int):
        self.trie, self.order = trie, order
        self.keys, self.values = np.full(1 << SLOTS_LOG2, _EMPTY), np.zeros(1 << SLOTS_LOG2)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for gram, owner in grams(texts, self.order):
            slot = _slot(gram)
            value = self.values[slot]
            miss = np.flatnonzero(self.keys[slot] != gram)
            if len(miss):
                new, back = np.unique(gram[miss], return_inverse=True)
                log = self.trie.log10(new)
                value[miss] = log[back]
                at = _slot(new)
                self.keys[at], self.values[at] = new, log
                # of new grams that share a slot numpy may keep either: write both arrays from one winner
                winner = np.unique(at, return_index=True)[1]
                self.keys[at[winner]], self.values[at[winner]] = new[winner], log[winner]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first]] += np.add.reduceat(value, first)
        return out


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def dealt(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``chunk`` with the rows' ``doc_id, text`` (a null text is empty), each chunk's distinct ``gram`` and its ``n`` in training
    texts, and training tokens ``word, n`` (the end token is the empty word). ``rows``: doc_id, text, training."""

    def said(names: dict[str, pa.Array]) -> pa.RecordBatch:
        size = len(next(iter(names.values())))
        return pa.RecordBatch.from_arrays([names.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, words = TaskContext.get().partitionId() << 32, 0, Counter()
        seen = {True: GramCounter(), False: GramCounter()}

        def spoken() -> Iterator[pa.RecordBatch]:
            keys = list(words)
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield said({"word": pa.array(part, pa.binary()), "n": pa.array([words[k] for k in part], pa.int64())})
            words.clear()

        def closed() -> Iterator[pa.RecordBatch]:
            (keys, n), (more, _) = seen[True].items(), seen[False].items()
            more = np.setdiff1d(more, keys)
            keys, n = np.concatenate([keys, more]), np.concatenate([n, np.zeros(len(more), np.int64)])
            for i in range(0, len(keys), 500_000):
                part = keys[i : i + 500_000]
                yield said({"chunk": pa.array(np.full(len(part), chunk)), "gram": pa.array(part.view(np.int64)), "n": pa.array(n[i : i + 500_000])})
            seen.update({True: GramCounter(), False: GramCounter()})

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                raw, training = [_raw(t) for t in texts], part.column(2).to_pylist()
                for kind, counter in seen.items():
                    for gram, _ in grams([r for r, own in zip(raw, training, strict=True) if own == kind], order):
                        counter.add(gram)
                for r, own in zip(raw, training, strict=True):
                    if own:
                        words.update(r.lower().split())
                if any(training):
                    words[b""] += sum(training)
                size += sum(map(len, raw))
                yield said({"chunk": pa.array(np.full(len(raw), chunk)), "doc_id": part.column(0), "text": pa.array(texts, pa.string())})
                if size >= PIECE:
                    yield from closed()
                    chunk, size = chunk + 1, 0
                if len(words) > 1_000_000:
                    yield from spoken()
        yield from spoken()
        yield from closed()

    return rows.select("doc_id", "text", "training").mapInArrow(counted, "chunk long, doc_id long, text string, gram long, word binary, n long")


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, back = np.unique(key, return_inverse=True)
    return own.astype(np.uint64), np.bincount(back, n, len(own)).astype(np.int64)


def _levels(gram: np.ndarray, n: np.ndarray, orders: range, least: int) -> tuple[list, list]:
    """Kept nodes and contexts' totals of ``orders`` from longer grams and their counts."""
    nodes, totals = [], []
    for j in orders:
        own, m = _sums(gram & np.uint64((1 << 9 * (j + 1)) - 1), n)
        totals.append(_sums(own >> np.uint64(9), m))
        nodes.append((own[m >= least], m[m >= least]))
    return nodes, totals


def gram_values(asked: DataFrame, counted: DataFrame, order: int = ORDER, share: float = 0.0) -> DataFrame:
    """``chunk, gram, value`` (log10) for the rows of ``asked`` (chunk, gram) by the counts ``counted`` (gram, n).

    No task holds more of the trie than some whole buckets and the broadcast levels.
    """
    near = min(NEAR, order)
    least = max(1, math.ceil((counted.agg(F.sum("n")).first()[0] or 0) * share))
    short = counted.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 9 * near) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow() if near else None
    low = _levels(short["gram"].to_numpy().astype(np.uint64), short["n"].to_numpy(), range(near), least) if near else ([], [])
    shared = counted.sparkSession.sparkContext.broadcast(low)
    bucket = F.shiftrightunsigned("gram", 9).bitwiseAND(F.lit((1 << 9 * near) - 1)).alias("bucket")
    rows = counted.select(F.lit(None).cast("long").alias("chunk"), "gram", "n", bucket).unionByName(asked.select("chunk", "gram", F.lit(0).cast("long").alias("n"), bucket))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, totals = shared.value

        def evaluated(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ask = table.column("chunk").is_valid().to_numpy()
            gram, n = table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy()
            own, more = _levels(gram[~ask], n[~ask], range(near, order + 1), least)
            new, back = np.unique(gram[ask], return_inverse=True)
            value = Trie([*nodes, *own], [*totals, *more]).log10(new)[back]
            chunk = table.column("chunk").drop_null().to_numpy()
            for i in range(0, len(value), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(chunk[i : i + ROWS]), pa.array(gram[ask][i : i + ROWS].view(np.int64)), pa.array(value[i : i + ROWS])], names=["chunk", "gram", "value"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("bucket").to_numpy()
                back = int(np.searchsorted(key, key[-1]))  # buckets arrive in order; the last may go on
                if back:
                    yield from evaluated(table.slice(0, back))
                held, size = table.slice(back).to_batches(), size - back
        if size:
            yield from evaluated(pa.Table.from_batches(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(valued, "chunk long, gram long, value double")


def score_texts(docs: DataFrame, k: int = 5, hold: int = 1, order: int = ORDER, share: float = 0.0, hot_words: int = HOT_WORDS) -> DataFrame:
    """Scores of every row of ``docs`` by models of the rows whose fold is not ``hold``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), (fold("doc_id", k) != hold).alias("training"))
    table = cut(dealt(rows, order), "dealt")
    words = cut(table.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
    asked = table.where(F.col("gram").isNotNull()).select("chunk", "gram", "n")
    counted = cut(asked.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    values = cut(gram_values(asked, counted, order, share), "values")
    facts = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = facts["n"] or 0, facts["v"]
    hot = words.where(F.col("n") * hot_words >= total).toArrow()
    z = total + 0.5 * (distinct + 1)
    model = spark.sparkContext.broadcast(dict(zip(hot["word"].to_pylist(), hot["n"].to_pylist(), strict=True)))
    texts = table.where(F.col("text").isNotNull()).select("chunk", "doc_id", "text", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("value"))
    met = texts.unionByName(values.select("chunk", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "gram", "value"))
    met = met.repartition("chunk").sortWithinPartitions("chunk", F.col("gram").isNull())  # a chunk's values come before its texts

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Scorer]]:
        """Slices of texts, each with its chunk's scorer."""
        now, held, scorer = None, [], None
        for batch in batches:
            chunk, is_text = batch.column(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(chunk) != 0) | (is_text[1:] != is_text[:-1])) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if chunk[a] != now:
                    now, held, scorer = chunk[a], [], None
                if not is_text[a]:
                    held.append((batch.column(3).slice(a, b - a).to_numpy(), batch.column(4).slice(a, b - a).to_numpy()))
                    continue
                if scorer is None:
                    scorer, held = Scorer(Values(*(np.concatenate(c) for c in zip(*held, strict=True))), order), []
                for i in range(a, b, 256):
                    yield batch.slice(i, min(256, b - i)), scorer

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = {w: math.log10((n + 0.5) / z) for w, n in model.value.items()}
        row = TaskContext.get().partitionId() << 40
        for part, scorer in parts(batches):
            raw = [_raw(t) for t in part.column(2).to_pylist()]
            heads, rare = [], ([], [], [])
            for r in raw:
                own = r.lower().split()
                own.append(b"")
                base, known, cold = 0.0, 0, Counter()
                for w in own:
                    if (x := log.get(w)) is not None:
                        base += x
                        known += 1
                    else:
                        cold[w] += 1
                heads.append((row, len(own), known, base))
                rare[0].extend([row] * len(cold))
                rare[1].extend(cold)
                rare[2].extend(cold.values())
                row += 1
            ids, n, known, base = zip(*heads, strict=True)
            none = pa.nulls(len(raw), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), none, pa.array(n, pa.int64()), part.column(1), pa.array(known, pa.int64()), pa.array(base), pa.array(scorer(raw))], names=names)
            for j in range(0, len(rare[0]), 200_000):
                m = len(rare[0][j : j + 200_000])
                yield pa.RecordBatch.from_arrays([pa.array(rare[0][j : j + 200_000], pa.int64()), pa.array(rare[1][j : j + 200_000], pa.binary()), pa.array(rare[2][j : j + 200_000], pa.int64()), *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=names)

    names = ["row", "word", "n", "doc_id", "known", "base", "score"]
    made = cut(met.mapInArrow(scored, "row long, word binary, n long, doc_id long, known long, base double, score double"), "scored")
    heads = made.where(F.col("word").isNull())
    rare = made.where(F.col("word").isNotNull()).select("row", "word", F.col("n").alias("tf"))
    met = rare.join(words.where(F.col("n") * hot_words < total), "word", "left")
    met = met.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(z)))).alias("more"))
    out = heads.join(cut(met, "met"), "row", "left")
    return out.select("doc_id", (fold("doc_id", k) == hold).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
