"""SimHash near-duplicates: a binary trie joined with itself under a Hamming budget.

Fingerprints are made one for each document; from there on only *distinct* fingerprints are
searched, so copies are never paired. Two fingerprints within ``BUDGET`` bits agree on at least
one of ``BUDGET + 1`` equal blocks of bits; each fingerprint is dealt to its blocks, and the
rows that agree on a block form a trie over the other bits. Pairs of trie nodes are walked
down together: a pair adds one to its error where it parts, and is left once that exceeds the
budget. A block that too many fingerprints share is dealt again by blocks of the rest of its bits,
with nothing dropped. What leaves a trie is a star for each class found in it.

Results by case: a null or blank text has fingerprint 0, linked like any other; under three words
the whole sequence is the one shingle; repeated rows are rows of one class; a null id keeps its
row and never names a class unless all ids of the class are null; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tokens
from .graph import components

WORDS = 3
SEED = 42
BUDGET = 3
#: Fingerprints that may share a block before it is dealt again by the rest of its bits.
CROWD = 20_000
#: Node pairs walked at a time, and leaf pairs below which a node pair is compared outright.
FRONT, LEAF = 1 << 19, 64
#: Minhash bands, and values in each: a pair of similarity 0.8 shares none with a chance of 1.3e-7, a closer one with less.
BANDS, ROWS = 40, 5
#: Sets of a band that one group holds at most; beyond, blocks of half as many meet two at a time.
MEMBERS = 4096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    import xxhash

    own = tokens(text)
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(own) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, fp``: the fingerprint as a signed long; ``mark`` is a hash of the text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "mark", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text")).mapInArrow(made, "doc_id long, mark long, fp long")


def _without(value, offset: int, width: int):
    """A column's bits without the ``width`` ones from ``offset`` on."""
    high = F.shiftrightunsigned(value, offset + width) if offset + width < 64 else F.lit(0).cast("long")
    return F.shiftleft(high, offset).bitwiseOR(value.bitwiseAND(F.lit((1 << offset) - 1)))


def _deal(rows: DataFrame, bits: int, budget: int) -> tuple[DataFrame, int]:
    """``key, rest, fp`` rows dealt to ``budget + 1`` blocks of their ``bits`` remaining bits."""
    width, out = bits // (budget + 1), None
    for b in range(budget + 1):
        value = F.shiftrightunsigned("rest", b * width).bitwiseAND(F.lit((1 << width) - 1))
        part = rows.select(F.concat("key", F.lit(f"/{b}:"), F.hex(value)).alias("key"), _without(F.col("rest"), b * width, width).alias("rest"), "fp")
        out = part if out is None else out.unionByName(part)
    return out, bits - width


def trie_pairs(trie: np.ndarray, groups: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within ``budget`` bits, of equal group, in the sorted ``groups, trie``.

    ``trie`` holds values of ``bits`` bits, sorted within each run of equal ``groups``.
    """
    full = (groups.astype(np.uint64) << np.uint64(bits)) | trie
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    lo, hi = edges[:-1], edges[1:]
    more = hi - lo > 1
    stack = [(0, lo[more], hi[more], lo[more], hi[more], np.zeros(more.sum(), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONT:
            stack += [(depth, *(x[i : i + FRONT] for x in (alo, ahi, blo, bhi, err))) for i in range(0, len(alo), FRONT)]
            continue
        few = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth == bits)
        size, width = ((ahi - alo) * (bhi - blo))[few], (bhi - blo)[few]
        for at in range(0, len(size), 1 << 14):
            n, w = size[at : at + (1 << 14)], width[at : at + (1 << 14)]
            owner = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            i, j = alo[few][at : at + (1 << 14)][owner] + step // w[owner], blo[few][at : at + (1 << 14)][owner] + step % w[owner]
            near = (i < j) & (np.bitwise_count(trie[i] ^ trie[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        if few.all() or depth == bits:
            continue
        alo, ahi, blo, bhi, err = (x[~few] for x in (alo, ahi, blo, bhi, err))
        bit, under = np.uint64(1 << (bits - 1 - depth)), np.uint64(bits - depth)
        split = lambda a: ((full[a] >> under) << under) | bit
        amid, bmid = np.searchsorted(full, split(alo)), np.searchsorted(full, split(blo))
        amid, bmid, same = np.clip(amid, alo, ahi), np.clip(bmid, blo, bhi), alo == blo
        parts = [(alo, amid, blo, bmid, err, None), (amid, ahi, bmid, bhi, err, None), (alo, amid, bmid, bhi, err + 1, None), (amid, ahi, blo, bmid, err + 1, same)]
        kept = [[x[ok] for x in p[:5]] for p in parts if (ok := (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget) & (True if p[5] is None else ~p[5])).any()]
        if kept:
            stack.append((depth + 1, *(np.concatenate(c) for c in zip(*kept, strict=True))))


def _stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` items the least item of its class."""
    root = np.arange(n)

    def flat() -> None:
        while (up := root[root] != root).any():
            root[up] = root[root[up]]

    for i, j in pairs:
        while True:
            flat()
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            np.minimum.at(root, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
    flat()
    return root


def _joined(dealt: DataFrame, bits: int, budget: int) -> DataFrame:
    """Star edges ``a, b`` within each key's trie; keys arrive sorted and are walked some thousand rows at a time."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def stars(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = table.column("key").combine_chunks().dictionary_encode()
            key = (key.chunk(0) if isinstance(key, pa.ChunkedArray) else key).indices.to_numpy()
            rest, fp = table.column("rest").to_numpy().view(np.uint64), table.column("fp").to_numpy()
            cuts = [0, *np.flatnonzero(np.diff(key) != 0) + 1, len(key)]
            begin = 0
            for k in range(1, len(cuts)):
                if cuts[k] - begin >= CROWD or k - 1 and (key[cuts[k] - 1] - key[begin]) >= 30_000 or k == len(cuts) - 1:
                    own = slice(begin, cuts[k])
                    root = _stars(cuts[k] - begin, trie_pairs(rest[own], key[own] - key[begin], bits, budget))
                    linked = root != np.arange(len(root))
                    if linked.any():
                        yield pa.RecordBatch.from_arrays([pa.array(fp[own][linked]), pa.array(fp[own][root[linked]])], names=["a", "b"])
                    begin = cuts[k]

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CROWD:
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column("key")
                last = key[rows - 1].as_py()
                back = rows - 1
                while back and key[back - 1].as_py() == last:
                    back -= 1
                if back:
                    yield from stars(whole.slice(0, back).combine_chunks())
                    held, rows = whole.slice(back).to_batches(), rows - back
        if rows:
            yield from stars(pa.Table.from_batches(held).combine_chunks())

    return dealt.select("key", "rest", "fp").repartition("key").sortWithinPartitions("key", "rest").mapInArrow(walked, "a long, b long")


def links(distinct: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints ``fp``; their classes are those of all pairs within ``budget`` bits."""
    dealt, bits = _deal(distinct.select(F.lit("").alias("key"), F.col("fp").alias("rest"), "fp"), 64, budget)
    out = None
    while True:
        crowded = cut(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded")
        last = bits // (budget + 1) < 2 or crowded.isEmpty()
        part = _joined(dealt if last else dealt.join(crowded, "key", "left_anti"), bits, budget)
        out = part if out is None else out.unionByName(part)
        if last:
            return out
        dealt, bits = _deal(cut(dealt.join(crowded, "key", "left_semi"), "again"), bits, budget)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a shorter text is one shingle, a blank one has none."""
    import xxhash

    own = tokens(text)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(own[i : i + words]), SEED) for i in range(max(1, len(own) - words + 1))], np.uint64)) if own else np.zeros(0, np.uint64)


def near_bits(similarity: float, bits: int = 64) -> int:
    """Differing bits that sets of at least this similarity stay within, but for one pair in some 100,000 at the bound itself.

    Sets of Jaccard similarity s have a cosine of 2s / (1 + s) or more, and each bit differs with the angle's share of the half
    circle, or a quarter more where sets hold few shingles; 4.5 deviations are added.
    """
    p = 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(min(bits, bits * p + 4.5 * np.sqrt(bits * p * (1 - p))))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def similar_stars(sets: list[np.ndarray], block: np.ndarray, similarity: float, budget: int | None = None) -> np.ndarray:
    """For each set the least index of its class; links are pairs of at least ``similarity``, of unequal ``block`` unless all are equal.

    The trie of the sets' fingerprints is joined with itself under the budget; pairs not linked yet are compared exactly.
    """
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    here, root, across = np.zeros(int(flat.max()) + 1, bool), np.arange(len(sets)), bool((block != block[0]).any())

    def compare(i: int, others: np.ndarray) -> None:
        others = others[root[others] != root[i]]
        others = others[np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i])]
        for at in range(0, len(others), 512):
            j = others[at : at + 512]
            j = j[root[j] != root[i]]
            if not len(j):
                continue
            here[flat[begin[i] : begin[i + 1]]] = True
            places = np.repeat(begin[j] - (np.cumsum(sizes[j]) - sizes[j]), sizes[j]) + np.arange(sizes[j].sum())
            both = np.add.reduceat(here[flat[places]].astype(np.int64), np.cumsum(sizes[j]) - sizes[j])
            here[flat[begin[i] : begin[i + 1]]] = False
            for r in set(root[j[both >= similarity * (sizes[i] + sizes[j] - both)]].tolist()) - {root[i]}:
                low, high = sorted((int(r), int(root[i])))
                root[root == high] = low

    compare(0, np.flatnonzero(block != block[0]) if across else np.arange(1, len(sets)))  # settles a family of copies at once
    trie = np.array([set_fingerprint(x) for x in sets], np.uint64)
    order = np.argsort(trie, kind="stable")
    for x, y in trie_pairs(trie[order], np.zeros(len(order), np.int64), 64, near_bits(similarity) if budget is None else budget):
        x, y = order[x], order[y]
        open_ = (root[x] != root[y]) & ((block[x] != block[y]) | (not across))
        x, y = x[open_], y[open_]
        turn = np.argsort(x, kind="stable")
        x, y = x[turn], y[turn]
        cuts = [0, *np.flatnonzero(np.diff(x)) + 1, len(x)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                compare(int(x[a]), y[a:b])
    return root


def similar_links(docs: DataFrame, words: int, similarity: float, crowd: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, mark, fp`` (a hash of the text's set of shingles), and edges ``a, b`` between sets of at least that Jaccard similarity.

    Sets are dealt to ``BANDS`` minhash bands. Within a band the trie of fingerprints is joined with itself; what stays within
    the budget is compared exactly. A band of more than ``crowd`` sets is cut into blocks, and every two blocks meet in a group of their own.
    """
    rng = np.random.default_rng(SEED)
    factor = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fps, bands = [], []
            for raw in batch.column(2):
                own = shingles(raw.as_py(), words)
                fps.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
                for i in range(0, len(own), 512):
                    least = np.minimum(least, (own[i : i + 512, None] * factor + shift).min(0))
                bands.append([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))] if len(own) else [])
            signed = pa.array([np.array(b, np.uint64).view(np.int64) for b in bands], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), signed], names=["doc_id", "mark", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    fps = cut(rows.mapInArrow(made, "doc_id long, mark long, fp long, bands array<long>"), "fps")
    one = cut(fps.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("x"), F.first("bands").alias("bands")), "one")
    dealt = one.select("fp", F.explode("bands").alias("key"))
    groups = dealt.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("sign")).where("lo != hi")
    groups = cut(groups.groupBy("lo", "hi", "n", "sign").agg(F.min("key").alias("key")).select("key", "n"), "groups")  # bands with equal members once
    blocks = F.when(F.col("n") > crowd, F.ceil(2 * F.col("n") / crowd)).otherwise(1)
    members = dealt.join(groups, "key").withColumn("block", F.pmod(F.xxhash64("fp"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = cut(members.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp"), "members")
    named = members.select("fp").distinct().join(one, "fp").select("fp", F.col("x.doc_id").alias("d"), F.col("x.mark").alias("m"))
    texts = rows.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("fp", "text").dropDuplicates(["fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, own, blocks = None, [], [], []

        def stars() -> Iterator[pa.RecordBatch]:
            root = similar_stars(sets, np.array(blocks), similarity) if len(sets) > 1 else np.zeros(len(sets), np.int64)
            met = np.flatnonzero(root != np.arange(len(root)))
            if len(met):
                names = np.array(own, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[met]), pa.array(names[root[met]])], names=["a", "b"])

        for batch in batches:
            heads = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for (key, lo, hi, block, fp), raw in zip(heads, batch.column(5), strict=True):
                if (key, lo, hi) != now:
                    yield from stars()
                    now, sets, own, blocks = (key, lo, hi), [], [], []
                sets.append(shingles(raw.as_py(), words))
                own.append(fp)
                blocks.append(block)
        yield from stars()

    place = ["key", "lo", "hi"]
    met = members.join(cut(texts, "texts"), "fp").select(*place, "block", "fp", "text")
    return fps.drop("bands"), cut(met.repartition(*place).sortWithinPartitions(*place, "fp").mapInArrow(linked, "a long, b long").distinct(), "links")


def classes(fps: DataFrame, budget: int = BUDGET, crowd: int = CROWD, edges: DataFrame | None = None) -> DataFrame:
    """``fp, component_id`` for every fingerprint of ``fps`` (doc_id, fp), which is read more than once; ``edges``: other links than by bits."""
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    roots = components(links(least.select("fp"), budget, crowd) if edges is None else edges)
    rooted = cut(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return cut(rooted.join(names, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, words: int = WORDS) -> DataFrame:
    """Every document with ``fingerprint`` (16 hex digits) and ``component_id``."""
    fps = cut(fingerprints(docs, words), "fps")
    return fps.join(classes(fps, budget), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = BUDGET, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """One document of each class stays: that of the least id, then of the least text hash; of equal rows one.

    With ``similarity``, classes are linked by the Jaccard similarity of shingles in place of fingerprints' bits.
    """
    fps, edges = (cut(fingerprints(docs, words), "fps"), None) if similarity is None else similar_links(docs, words, similarity)
    best = fps.join(classes(fps, budget, edges=edges), "fp").groupBy("fp", "component_id").agg(F.min(F.struct("doc_id", "mark")).alias("x")).groupBy("component_id").agg(F.min("x").alias("x"))
    best = cut(best.select("x.doc_id", "x.mark"), "best")
    copies = fps.join(best, (fps.doc_id.eqNullSafe(best.doc_id)) & (fps.mark == best.mark)).groupBy(best.doc_id, best.mark).agg(F.count("*").alias("copies"))
    copies = cut(copies.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "copies"), "copies")
    kept = docs.join(copies, docs["doc_id"].cast("long").eqNullSafe(copies["_d"]) & (F.xxhash64(docs["text"]) == copies["_m"]))
    return kept.where("copies = 1").select(docs["*"]).unionByName(kept.where("copies > 1").dropDuplicates(["_d", "_m"]).select(docs["*"]))
