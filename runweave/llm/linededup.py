"""Line dedup by a segment-partition edit join.

A line goes if an equal one, or (for lines of at least ``MIN_CHARS`` characters) one within ``THRESHOLD``
edits of it, comes before it, in the order of document id, then place; blank lines stay. Equal lines are found by hash. For unequal ones,
each line is split into threshold + 1 segments; at most threshold edits leave one untouched, so
two near lines share a substring that stands where the shorter line's segmentation has it, up to a
shift that the edits allow. Keys of (length, segment, substring) are indexed and probed, with the
shorter line's length in the key; candidates are verified by a banded bit-parallel edit distance.

Lines of which more words, or letters, differ than the edits can change (by sketches of parity bits) are not compared.
A substring that many lines share is not paired out. All its lines are first verified against
its earliest ones, which settles families of near copies in one comparison each. Lines that stay open meet only those
whose lengths, and distances to two pivot lines, differ by no more than the threshold (the triangle inequality asks that
of near lines). Where too many lines are alike in that as well, they lose
the beginning and end that all of them share (edit distances do not change by that), are split into twice the threshold of
segments, and dealt by all segments but those that edits may fall into; what is left to compare is the text of those.

Results by case: a null or empty text has no line to remove; rows equal in id and text are treated alike
(their lines count once); a null id comes first; a document of which nothing but blank lines is left is dropped by
``deduplicate``; an empty table gives an empty result; columns of other names
are kept as they are. Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, whole

THRESHOLD = 2
MIN_CHARS = 32
#: Pairs under one key up to which its lines are paired out. Lines of a cell of pivot distances from which on it is dealt again. Cut-off of distances.
CROWD, CELL, FAR = 1 << 14, 2048, 24
LETTERS = "abcdefghijklmnopqrstuvwxyz "
LINE = ["d", "t", "p"]
BLANKS = " \t\r\x0b\x0c"
#: Blocks of a line, most of which must stand in a near one.
BLOCKS = 16
#: Longest common beginning or end that is looked for at once.
STEPS = [1 << i for i in range(20, -1, -1)]
#: Shared keys (8 bytes each) that are broadcast at most, or half the places of removed lines (4 bytes each); more are joined by a shuffle.
BROADCAST = 1_000_000


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(whole()).alias("t")]


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) == ""


def lines(docs: DataFrame) -> DataFrame:
    """``d, t`` (the document), ``p`` (place), ``line`` and its length ``n`` of every line that is not blank."""
    each = docs.where(F.length("text") > 0).select(*_key(), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return each.where(~_blank(F.col("line"))).withColumn("n", F.length("line"))


def _hashed(each: DataFrame) -> DataFrame:
    return each.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))


def keys(each: DataFrame, threshold: int) -> DataFrame:
    """``each`` with ``key, probe``: what its lines are indexed under (probe 0) and ask for (probe 1).

    The combinations of length, segment and shift are rows of a literal table, so that the plan stays
    small. Edits before and after an untouched segment j need not outnumber the segments there.
    """
    parts = threshold + 1
    asks = [(delta, j, s) for delta in range(parts) for j in range(parts) for s in range(-threshold, parts) if abs(s) <= j and abs(delta - s) <= threshold - j]
    table = F.array(*[F.struct(F.lit(delta).alias("delta"), F.lit(j).alias("j"), F.lit(s).alias("s"), F.lit(int(delta > 0 or s != 0)).alias("probe")) for delta, j, s in asks])
    asked = each.withColumn("x", F.explode(table))
    n = F.col("n") - F.col("x.delta")
    base, odd = F.floor(n / parts).cast("int"), n % parts  # the last segments are one longer if need be
    begin = base * F.col("x.j") + F.greatest(F.lit(0), F.col("x.j") - parts + odd) + F.col("x.s")
    size = base + F.when(F.col("x.j") >= F.lit(parts) - odd, 1).otherwise(0)
    asked = asked.where((begin >= 0) & (begin + size <= F.col("n")))
    # in lines of one-byte characters a substring of the bytes is the same one, and is found without counting characters
    own = [F.xxhash64(n, "x.j", F.substring(line, begin + 1, size)) for line in (F.col("line").cast("binary"), F.col("line"))]
    return asked.select(*each.columns, F.when(F.octet_length("line") == F.col("n"), own[0]).otherwise(own[1]).alias("key"), F.col("x.probe").alias("probe"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _struct(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def _trimmed(pair: Column) -> Column:
    """The structs' ``a`` and ``b`` without whole blocks of common beginning, 64 blocks at most."""
    short = F.least(F.length(pair["a"]), F.length(pair["b"]))
    sized = _let(short, lambda n: _struct(block=F.greatest(F.lit(16), F.ceil(n / 64).cast("int")), n=n))

    def differ(x: Column) -> Column:
        count = (x["n"] / x["block"]).cast("int")
        same = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: (i <= count) & (F.substring(pair["a"], (i - 1) * x["block"] + 1, x["block"]) == F.substring(pair["b"], (i - 1) * x["block"] + 1, x["block"])))
        return _let(F.array_position(same, False), lambda first: F.when(first == 0, count).otherwise(first - 1).cast("int") * x["block"] + 1)

    return _let(_let(sized, differ), lambda at: _struct(a=F.substring(pair["a"], at, F.length(pair["a"])), b=F.substring(pair["b"], at, F.length(pair["b"]))))


def _bit_parallel(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of ``a`` and ``b`` if at most ``threshold`` (else more than it), lengths differing by no more.

    A column of the distance matrix is held as vertical differences in a band of 2 * threshold + 1 rows
    around the diagonal, one bit each in two words; the value at the band's lower edge is followed down the
    diagonal to the last row of ``a``, then along it.
    """
    width = 2 * threshold + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    lead = "\x00" * (threshold + 1)

    def word(value: int) -> Column:
        return F.lit(value).cast("long")

    def matches(x: Column, c: Column, i: Column) -> Column:
        own = [F.when(F.get(x, i + (k - threshold)) == c, word(1 << k)).otherwise(word(0)) for k in range(width)]
        return sum(own[1:], own[0])

    def step(z: Column, acc: Column, i: Column) -> Column:
        vp, vn, down_here = acc["vp"], acc["vn"], i < z["rows"] - threshold

        def words(m: Column) -> Column:
            return ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(word(mask))

        def moved(d: Column) -> Column:
            hp, hn, over = vn.bitwiseOR(d.bitwiseOR(vp).bitwiseXOR(word(mask))).bitwiseAND(word(mask)), d.bitwiseAND(vp), F.shiftrightunsigned(d, 1)
            along = F.when(hp.bitwiseAND(acc["at"]) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(acc["at"]) != 0, 1).otherwise(0)
            down = F.when(d.bitwiseAND(word(top)) == 0, 1).otherwise(0)
            return _struct(
                vp=hn.bitwiseOR(over.bitwiseOR(hp).bitwiseXOR(word(mask))).bitwiseAND(word(mask)),
                vn=over.bitwiseAND(hp),
                distance=acc["distance"] + F.when(down_here, down).otherwise(along),
                at=F.when(down_here, acc["at"]).otherwise(F.shiftrightunsigned(acc["at"], 1)),
            )

        new = _let(_let(matches(z["x"], F.get(z["y"], i), i), words), moved)
        # the last steps, along the row, are 2 * threshold at most and win back one each: from here on it stays above the threshold
        return F.when(acc["distance"] > 3 * threshold, acc).otherwise(new)

    start = _struct(vp=word(mask & (mask << threshold)), vn=word(0), distance=F.lit(threshold), at=word(top >> 1))
    letters = _struct(x=F.split(F.concat(F.lit(lead), a), ""), y=F.split(F.concat(F.lit(lead), b), ""))
    sized = _let(letters, lambda z: _struct(x=z["x"], y=z["y"], rows=F.size(z["x"])))
    return _let(sized, lambda z: F.aggregate(F.sequence(F.lit(0), F.size(z["y"]) - 1), start, lambda acc, i: step(z, acc, i), lambda acc: acc["distance"]))


def within(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """Whether the edit distance of ``a`` and ``b`` is at most ``threshold``: a necessary test, then the distance of what is not shared.

    Each edit falls into one of ``a``'s blocks at most; the others stand in ``b``, moved by no more than the threshold.
    """
    sized = _struct(a=a, b=b, w=F.greatest(F.lit(1), F.floor(F.length(a) / BLOCKS).cast("int")))

    def missing(x: Column, i: Column) -> Column:
        at = i * x["w"] + 1
        return ~F.contains(F.substring(x["b"], F.greatest(F.lit(1), at - threshold), x["w"] + 2 * threshold), F.substring(x["a"], at, x["w"]))

    few = _let(sized, lambda x: F.size(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: missing(x, i))) <= threshold)
    tails = _let(_struct(a=a, b=b), _trimmed)
    middles = _let(_let(tails, lambda x: _struct(a=F.reverse(x["a"]), b=F.reverse(x["b"]))), _trimmed)
    distance = _let(middles, lambda x: _bit_parallel(x["a"], x["b"], threshold))
    return F.when((F.abs(F.length(a) - F.length(b)) <= threshold) & few, distance <= threshold).otherwise(False)


def _later(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """``first, settled``: b of the pairs (a, b; a before b) whose lines are within the threshold."""
    own, other = (texts.select(F.col("first").alias(n), F.col("line").alias(f"line_{n}")) for n in "ab")
    met = pairs.distinct().join(own, "a").join(other, "b")
    return met.where(within(F.col("line_a"), F.col("line_b"), threshold)).select(F.col("b").alias("first"), F.lit(True).alias("settled")).distinct()


def _sketch(line: Column) -> Column:
    """For each of 64 classes of words, and of a few letters, the parity of their count: an edit changes three of the words' bits at most, and two of the letters'."""
    words = F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int"))))
    bits = [F.shiftleft((F.length(line) - F.length(F.replace(line, F.lit(c)))).bitwiseAND(F.lit(1)).cast("long"), i) for i, c in enumerate(LETTERS)]
    return _struct(words=words, letters=sum(bits[1:], bits[0]))


def _like(x: Column, y: Column, threshold: int) -> Column:
    """Whether two lines' sketches leave it possible that they are near."""
    apart = {n: F.bit_count(x[n].bitwiseXOR(y[n])) for n in ("words", "letters")}
    return (apart["words"] <= 3 * threshold) & (apart["letters"] <= 2 * threshold)


def _candidates(posted: DataFrame, threshold: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b; a before b, b open) of ``posted`` (key, probe, first, open, w, done, ...), and the rows of its crowded keys.

    All pairs of the other keys whose sketches ``w`` are near, and stars around the earliest lines of crowded ones.
    """
    indexed = F.when(F.col("probe") == 0, F.col("first"))
    facts = posted.groupBy("key").agg(F.sum(1 - F.col("probe")).alias("indexed"), F.count("*").alias("n"), F.min("first").alias("least"), F.max("first").alias("last"), F.min(indexed).alias("least_indexed"), F.bool_or("open").alias("any"), F.bool_or("done").alias("done"))
    size = F.col("indexed") * F.col("n")
    facts = facts.where("any AND indexed > 0 AND least != last").select("key", (F.col("done") | (size <= crowd)).alias("few"), "least", "least_indexed")
    sized = cut(posted.drop("done").join(facts, "key"), "sized")
    few = sized.where("few")
    index, ask = few.where("probe = 0").select("key", F.col("first").alias("x"), F.col("open").alias("ox"), F.col("w").alias("wx")), few.select("key", F.col("first").alias("y"), F.col("open").alias("oy"), F.col("w").alias("wy"))
    like = _like(F.col("wx"), F.col("wy"), threshold)
    pairs = index.join(ask, "key").where(F.expr("(x < y AND oy) OR (y < x AND ox)") & like).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    crowded = sized.where("NOT few").drop("few")
    for center in ("least", "least_indexed"):
        pairs = pairs.unionByName(crowded.where(F.col("open") & (F.col(center) < F.col("first"))).select(F.col(center).alias("a"), F.col("first").alias("b")))
    return pairs, crowded.drop("least", "least_indexed")


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of ``a`` and ``b``."""
    longer = lambda n, step: F.when((n + step <= F.length(a)) & (n + step <= F.length(b)) & (F.substring(a, F.lit(1), n + step) == F.substring(b, F.lit(1), n + step)), n + step).otherwise(n)
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), longer)


def _narrowed(members: DataFrame, threshold: int) -> DataFrame:
    """``key, probe, first, open, w, r, tiny``: ``members`` (key, first, open, w, r, head, tail) dealt by the segments of r that edits leave alone; r becomes the others.

    ``head`` and ``tail``: the lengths of what all texts of a key begin and end with. ``tiny``: the indexed texts are of the threshold's
    length at most, so each is near every other, and does not get shorter.
    """
    parts = 2 * threshold
    bare = members.withColumn("r", F.substring("r", F.col("head") + 1, F.length("r") - F.col("head") - F.col("tail")))
    # the segments that edits fall into, with what those add to the length: one edit at least in each, so many in all as the threshold allows
    asks = [(ids, own) for k in range(1, parts) for ids in combinations(range(parts), k) for own in product(range(-threshold, threshold + 1), repeat=k) if sum(max(1, abs(c)) for c in own) <= threshold and sum(own) >= 0]
    spare = [(parts, 0)] * threshold
    table = F.array(*[F.struct(F.lit(sum(own)).alias("delta"), F.lit(int(any(own))).alias("probe"), F.lit(sum(1 << i for i in ids)).alias("mask"), *[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")).alias(f"e{t}") for t, (i, c) in enumerate([*zip(ids, own, strict=True), *spare][:threshold])]) for ids, own in asks])
    asked = bare.withColumn("x", F.explode(table)).select("key", "first", "open", "w", "r", "x.*", (F.length("r") - F.col("x.delta")).alias("m")).where("m >= 0")
    base, odd = F.floor(F.col("m") / parts).cast("int"), F.col("m") % parts

    def begin(i: Column) -> Column:
        return F.least(F.col("m"), i * base + F.greatest(F.lit(0), i - parts + odd))

    moved, length, sound, cuts = F.lit(0), F.lit(0), F.lit(True), []
    for t in range(threshold):
        i, c = F.col(f"e{t}.i"), F.col(f"e{t}.c")
        own = begin(i + 1) - begin(i)
        cuts.append((begin(i) + moved + 1, own + c))
        moved, length, sound = moved + c, length + own, sound & (own + c >= 0)
    left = F.col("r")
    for at, size in reversed(cuts):
        left = F.overlay(left, F.lit(""), at, size)
    other = F.concat(*[F.substring("r", at, size) for at, size in cuts])
    return asked.where(sound).select(F.xxhash64("key", "m", "mask", left).alias("key"), "probe", "first", "open", "w", other.alias("r"), (length <= threshold).alias("tiny"))


def _by_pivots(members: DataFrame, threshold: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b; b open) of ``members`` (key, first, open, w, r) that their distances to two of a key's texts leave possible, and the members of the cells that hold too many, each under a key of its own."""
    pivots = members.groupBy("key").agg(F.min_by("r", "first").alias("r0"), F.max_by("r", "first").alias("r1"))
    far = members.join(cut(pivots, "pivots"), "key")
    distance = [F.levenshtein("r", f"r{i}", FAR) for i in (0, 1)]
    far = far.select("key", "first", "open", "w", "r", F.length("r").alias("n"), *[((d + FAR + 2) % (FAR + 2)).alias(f"d{i}") for i, d in enumerate(distance)])  # -1, too far, is the last
    far, width = cut(far, "distances"), 2 * threshold + 1
    at = [F.floor(F.col(f"d{i}") / width) for i in (0, 1)]
    there = far.withColumn("cell", F.xxhash64("key", *at))
    around = [F.sequence(F.floor((F.col(f"d{i}") - threshold) / width), F.floor((F.col(f"d{i}") + threshold) / width)) for i in (0, 1)]
    asked = far.where("open").withColumn("c0", F.explode(around[0])).withColumn("c1", F.explode(around[1])).withColumn("cell", F.xxhash64("key", "c0", "c1"))
    full = cut(there.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("cell"), "full")
    x = there.join(full, "cell", "left_anti").select("cell", F.col("first").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "w", "d0", "d1")])
    y = asked.select("cell", F.col("first").alias("b"), "n", "w", "d0", "d1")
    near = (F.col("a") < F.col("b")) & _like(F.col("w"), F.col("w_a"), threshold)
    for c in ("n", "d0", "d1"):
        near = near & (F.abs(F.col(c) - F.col(f"{c}_a")) <= threshold)
    pairs = y.join(x, "cell").where(near).select("a", "b")
    rest = there.select("cell", "first", "open", "w", "r").unionByName(asked.select("cell", "first", "open", "w", "r")).join(full, "cell", "left_semi")
    return pairs, rest.withColumnRenamed("cell", "key").dropDuplicates(["key", "first"])


def _crowded(crowded: DataFrame, texts: DataFrame, near: DataFrame, threshold: int, crowd: int, cell: int) -> DataFrame:
    """``near`` (first, settled) and the lines near an earlier one that only ``crowded`` keys show."""
    own = texts.select("first", F.col("line").alias("r"))
    members = crowded.select("key", "probe", "first", "w").join(own, "first").withColumn("tiny", F.lit(False))
    while True:
        members = members.drop("open").join(near, "first", "left").withColumn("open", F.col("settled").isNull()).drop("settled")
        members = cut(members.repartition("first"), "members")  # not by key: one key may have most of the lines
        busy = members.groupBy("key").agg(F.bool_or("open").alias("any"), F.min("first").alias("least"), F.max("first").alias("last")).where("any AND least != last")
        members = members.join(cut(busy.select("key"), "busy"), "key", "left_semi")
        if members.isEmpty():
            return near
        pairs, rest = _by_pivots(members.where("NOT tiny").select("key", "first", "open", "w", "r").dropDuplicates(["key", "first", "r"]), threshold, cell)
        again = members.where("tiny").select("key", "probe", "first", "open", "w", "r", "tiny", F.lit(True).alias("done"))
        rest = cut(rest, "rest")
        # the first and the last text in order share what all of them begin with
        ends = [f(x).alias(n + m) for x, m in ((F.col("r"), ""), (F.reverse("r"), "_")) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        ends = rest.groupBy("key").agg(F.min(F.length("r")).alias("short"), *ends).withColumn("head", _common(F.col("lo"), F.col("hi")))
        ends = ends.select("key", "head", F.least(_common(F.col("lo_"), F.col("hi_")), F.col("short") - F.col("head")).alias("tail"))
        posted = _narrowed(rest.join(cut(ends, "ends"), "key"), threshold).withColumn("done", F.lit(False)).unionByName(again)
        posted = cut(posted, "posted")
        shared = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("probe").alias("probe"), F.bool_or("open").alias("any")).where("n > 1 AND probe = 0 AND any")
        more, members = _candidates(posted.join(cut(shared.select("key"), "shared"), "key", "left_semi"), threshold, crowd)
        near = cut(near.unionByName(_later(pairs.unionByName(more), texts, threshold)).distinct(), "near")


def near_lines(each: DataFrame, firsts: DataFrame, threshold: int = THRESHOLD, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """``first, settled``: first occurrences (struct d, t, p) with a near, unequal line before them.

    ``each``: hashed lines; ``firsts``: ``h1, h2, first`` of the distinct ones.
    """
    facts = keys(each.select("h1", "n", "line"), threshold).groupBy("key").agg(F.min("probe").alias("probe"), F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    shared = cut(facts.where("probe = 0 AND lo != hi").select("key"), "shared")
    own, same = firsts.select("h1", "h2", "first"), ["h1", "h2"]
    if shared.count() <= BROADCAST:  # the lines come along, and need not be read again
        met = cut(keys(each.select("h1", "h2", "n", "line"), threshold).join(F.broadcast(shared), "key").select("key", "probe", "h1", "h2", "line"), "met")
        texts = met.dropDuplicates(same).join(own, same).select("h1", "h2", "first", "line")
    else:
        met = cut(keys(each.select("h1", "h2", "n", "line"), threshold).select("key", "probe", "h1", "h2").join(shared, "key"), "met")
        named = met.select("h1", "h2").distinct().join(own, same).select("h1", "h2", "first")
        texts = each.select(F.struct(*LINE).alias("first"), "line").dropDuplicates(["first"]).join(named, "first").select("h1", "h2", "first", "line")
    texts = cut(texts.withColumn("w", _sketch(F.col("line"))), "texts")
    posted = met.groupBy("key", "h1", "h2").agg(F.min("probe").alias("probe")).join(texts.select("h1", "h2", "first", "w"), same)
    posted = cut(posted.select("key", "probe", "first", F.lit(True).alias("open"), "w", F.lit(False).alias("done")), "posted")
    pairs, crowded = _candidates(posted, threshold, crowd)
    return _crowded(crowded, texts, cut(_later(pairs, texts, threshold), "near"), threshold, crowd, cell)


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """``d, t, removed`` (array of places) for the documents that lose lines."""
    each = _hashed(lines(docs))
    places = cut(each.select(*LINE, "h1", "h2"), "places")
    firsts = cut(places.groupBy("h1", "h2").agg(F.min(F.struct(*LINE)).alias("first"), F.count("*").alias("n")), "firsts")
    near = near_lines(each.where(F.col("n") >= min_chars), firsts, threshold, crowd, cell)
    marks = firsts.join(near, "first", "left").where("n > 1 OR settled").select("h1", "h2", "first", F.coalesce("settled", F.lit(False)).alias("near"))
    gone = places.join(cut(marks, "marks"), ["h1", "h2"]).where(F.col("near") | (F.struct(*LINE) != F.col("first")))
    return cut(gone.select(*LINE).distinct().groupBy("d", "t").agg(F.collect_list("p").alias("removed")), "removed")


def _met(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` next to their removed places: that join, the places, all lines, the text that stays."""
    d, t, r = (free_name(docs, n) for n in ("_doc", "_text", "_removed"))
    own = docs.withColumns(dict(zip((d, t), _key(), strict=True)))
    small = (gone.agg(F.sum(F.size("removed") + 4)).first()[0] or 0) <= 2 * BROADCAST  # 4 bytes each
    met = own.join(gone.hint("broadcast" if small else "shuffle_hash").select(F.col("d").alias(d), F.col("t").alias(t), F.col("removed").alias(r)), [d, t], "left")
    places, every = F.col(r), F.split("text", "\n")

    def without(x: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), places), lambda i: F.get(x, i)), "\n")

    return met, places, every, F.when(places.isNull(), F.col("text")).otherwise(_let(every, without))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """``doc_id, text`` (without the removed lines), ``n_lines, n_long, n_removed`` of every row."""
    met, places, every, text = _met(docs.select("doc_id", "text"), removed_lines(docs, threshold, min_chars, crowd, cell))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(every))
    n_long = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(every, lambda x: F.length(x) >= min_chars)))
    return met.select("doc_id", text.alias("text"), n_lines.alias("n_lines"), n_long.alias("n_long"), F.when(places.isNull(), 0).otherwise(F.size(places)).alias("n_removed"))


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with near and equal lines removed; documents left with nothing but blank lines are dropped."""
    met, places, every, text = _met(docs, removed_lines(docs, threshold, min_chars))
    left = F.size(F.filter(every, lambda x: ~_blank(x))) - F.size(places)
    return met.where(places.isNull() | (left > 0)).select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def oracle(threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> str:
    """DuckDB SQL for the query's rows: all long lines of about equal length compared outright."""
    return f"""
WITH l AS (SELECT doc_id, p, string_split(text, chr(10))[p] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents) WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) != ''),
f AS (SELECT line, length(line) AS n, min((doc_id, p)) AS first FROM l GROUP BY line),
near AS (SELECT DISTINCT b.line FROM f a JOIN f b ON a.n >= {min_chars} AND b.n >= {min_chars} AND a.n BETWEEN b.n - {threshold} AND b.n + {threshold} AND a.first < b.first AND a.line != b.line AND levenshtein(a.line, b.line) <= {threshold}),
gone AS (SELECT l.doc_id, l.p FROM l JOIN f ON l.line = f.line WHERE f.first != (l.doc_id, l.p) OR l.line IN (SELECT line FROM near)),
per AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::INTEGER AS n_lines, coalesce(len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= {min_chars})), 0)::INTEGER AS n_long, coalesce(len(per.places), 0)::INTEGER AS n_removed,
    md5(CASE WHEN per.places IS NULL THEN coalesce(text, '') ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(per.places, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END) AS text_md5
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id"""
