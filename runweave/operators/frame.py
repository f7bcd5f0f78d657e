"""Keyed run-length vectors as immutable, lazy frames of segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import INF, NAN, UNARY, divide, finite, indicator, natural_key
from ..plans.scan import number, scan
from ..plans.segments import SEGMENT, coalesce_exact, coalesce_near, coverage, covered_keys, sweep

Number = int | float
SCHEMA = "seg_start long, seg_end long, value double"
_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide}


class SegmentFrame:
    """Vectors by key (``chromosome``, or ``chromosome`` and ``strand``): segments that tile ``[0, length)``.

    ``mode``: how results are coalesced, ``near`` (runs within 1e-5 of a group's first value) or ``exact``. ``tile``: None for one
    window per key, or a width of positions by which long keys are spread over tasks.
    ``names``: the frame's keys, repeats and all, where a shorter plan than ``df`` gives them.
    Where a key has no segments it has no rows: it does not exist.
    """

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, df: DataFrame, mode: str = "near", tile: int | None = None, names: DataFrame | None = None):
        if mode not in ("near", "exact"):
            raise ValueError(f"unknown mode {mode!r}")
        self.mode, self.tile = mode, tile
        self.stranded = "strand" in df.columns
        self.keys = ["chromosome", "strand"] if self.stranded else ["chromosome"]
        self.df, self._names = df.select(*self.keys, *SEGMENT), names

    # ---- construction -------------------------------------------------------------------------------------------

    @classmethod
    def empty(cls, spark: SparkSession, stranded: bool = True, **how) -> SegmentFrame:
        return cls(spark.createDataFrame([], "chromosome string, " + "strand string, " * stranded + SCHEMA), **how)

    @classmethod
    def from_runs(cls, df: DataFrame, ordinal: str, run: str = "Runs", value: str = "Values", **how) -> SegmentFrame:
        """Runs and values in the order of ``ordinal``; zero-length runs are dropped."""
        keys = [k for k in ("chromosome", "strand") if k in df.columns]
        runs = df.where(F.col(run) > 0).select(*keys, F.col(ordinal).alias("o"), F.col(run).cast("double").alias("n"), F.col(value).cast("double").alias("value"))
        placed = scan(runs, keys, "o", sums=("n",)).select(*keys, F.col("n_sum").cast("long").alias("seg_start"), (F.col("n_sum") + F.col("n")).cast("long").alias("seg_end"), "value")
        return cls(placed, **how).coalesce()

    @classmethod
    def from_dense(cls, df: DataFrame, pos: str = "pos", value: str = "value", **how) -> SegmentFrame:
        """One row for each position; runs by exact equality, every NaN a run of its own."""
        keys = [k for k in ("chromosome", "strand") if k in df.columns]
        cells = df.select(*keys, F.col(pos).cast("long").alias("seg_start"), F.col(value).cast("double").alias("value"))
        seen = scan(cells, keys, "seg_start", lags=("value", "seg_start"), leads=("seg_start",))
        new = F.col("seg_start_lag").isNull() | F.isnan("value") | (F.col("value") != F.col("value_lag"))
        marks = F.array_compact(F.array(F.when(new, F.struct(F.col("seg_start").alias("p"), F.col("value").alias("v"))), F.when(F.col("seg_start_lead").isNull(), F.struct((F.col("seg_start") + 1).alias("p"), F.lit(None).cast("double").alias("v")))))
        starts = scan(seen.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.*"), keys, "p", leads=("p",)).where("p_lead IS NOT NULL")
        return cls(starts.select(*keys, F.col("p").alias("seg_start"), F.col("p_lead").alias("seg_end"), F.col("v").alias("value")), **how)

    @classmethod
    def coverage(cls, intervals: DataFrame | str, stranded: bool = False, value_col: str | None = None, nb_cpu: int | None = None, spark: SparkSession | None = None, repeats: bool = True, **how) -> SegmentFrame:
        """How many (or how much of ``value_col``) of the ``intervals`` (a frame or a table's name) lie over each position.

        ``repeats``: False for many short keys whose intervals seldom share positions (see ``plans.segments.coverage``).
        """
        if isinstance(intervals, str):
            intervals = (spark or SparkSession.active()).table(intervals)
        keys = ["chromosome", "strand"] if stranded else ["chromosome"]
        return cls(coverage(intervals, keys, F.col(value_col) if value_col else None, how.get("tile"), repeats), names=covered_keys(intervals, keys), **how).coalesce("seg_end")

    @classmethod
    def from_dict(cls, vectors: dict, **how) -> SegmentFrame:
        """Frames of single vectors under their keys: names, or (name, strand) pairs."""
        if not vectors:
            return cls.empty(SparkSession.active(), **how)
        parts = [frame.df.select(*(F.lit(v).alias(n) for n, v in zip(("chromosome", "strand"), key if isinstance(key, tuple) else (key,), strict=False)), *SEGMENT) for key, frame in vectors.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cls(out, **how)

    def _new(self, df: DataFrame, names: DataFrame | None = None) -> SegmentFrame:
        return SegmentFrame(df, self.mode, self.tile, names)

    def _key_rows(self) -> DataFrame:
        """Each key once."""
        return (self.df if self._names is None else self._names).select(*self.keys).distinct()

    def _valued(self, value: Column) -> SegmentFrame:
        return self._new(self.df.withColumn("value", value), self._names)

    def coalesce(self, order: str = "seg_start") -> SegmentFrame:
        """Neighbouring equal (or near) runs as one. ``order``: ``seg_end`` where the rows are sorted by that already."""
        merge = coalesce_exact if self.mode == "exact" else coalesce_near
        return self._new(merge(self.df, self.keys, self.tile, order), self._names)

    def copy(self) -> SegmentFrame:
        return self._new(self.df, self._names)

    def with_key(self, other: SegmentFrame) -> SegmentFrame:
        """These vectors, with those of ``other`` in place of or beside the ones of the same key."""
        return self._new(self.df.join(other.df.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(other.df))

    # ---- arithmetic and comparison ------------------------------------------------------------------------------

    def merge_strands(self, labels: tuple[str, ...] | None = None) -> SegmentFrame:
        """The strands of each chromosome summed. ``labels``: the strands there are, if known."""
        if not self.stranded:
            return self
        labels = labels or tuple(r[0] for r in self.df.select("strand").distinct().orderBy("strand").collect())
        parts = [self.df.where(F.col("strand") == s).drop("strand") for s in labels]
        out = parts[0] if parts else self.df.drop("strand")
        for p in parts[1:]:
            out = sweep(out, p, ["chromosome"], _ARITHMETIC["add"], 0.0, self.tile)
        return self._new(out).coalesce()

    def _with(self, other: SegmentFrame, expr: Callable[[Column, Column], Column], pad: float = 0.0) -> SegmentFrame:
        x, y = (self, other) if self.stranded == other.stranded else (self.merge_strands(), other.merge_strands())
        return self._new(sweep(x.df, y.df, x.keys, expr, pad, self.tile)).coalesce()

    def _binary(self, name: str, other: SegmentFrame | Number, flipped: bool = False) -> SegmentFrame:
        f = _ARITHMETIC[name]
        if isinstance(other, SegmentFrame):
            return self._with(other, f)
        n, v = F.lit(float(other)), F.col("value")
        return self._valued(f(n, v) if flipped else f(v, n)).coalesce()

    def add(self, other, nb_cpu: int | None = None) -> SegmentFrame:
        return self._binary("add", other)

    def sub(self, other, nb_cpu: int | None = None) -> SegmentFrame:
        return self._binary("sub", other)

    def mul(self, other, nb_cpu: int | None = None) -> SegmentFrame:
        return self._binary("mul", other)

    def div(self, other, nb_cpu: int | None = None) -> SegmentFrame:
        return self._binary("div", other)

    __add__, __sub__, __mul__, __truediv__ = add, sub, mul, div

    def __radd__(self, n: Number) -> SegmentFrame:
        return self._binary("add", n, True)

    def __rsub__(self, n: Number) -> SegmentFrame:
        return self._binary("sub", n, True)

    def __rmul__(self, n: Number) -> SegmentFrame:
        return self._binary("mul", n, True)

    def __rtruediv__(self, n: Number) -> SegmentFrame:
        return self._binary("div", n, True)

    def __neg__(self) -> SegmentFrame:
        return self._valued(-F.col("value"))

    def compare(self, name: str, other: SegmentFrame | Number) -> SegmentFrame:
        """Indicator vectors of ``eq ne lt le gt ge``. For eq and ne a vector that has ended equals nothing."""
        if isinstance(other, SegmentFrame):
            return self._with(other, lambda a, b: indicator(name, a, b), NAN if name in ("eq", "ne") else 0.0)
        return self._valued(indicator(name, F.col("value"), float(other))).coalesce()

    def __eq__(self, other):  # type: ignore[override]
        return self.compare("eq", other)

    def __ne__(self, other):  # type: ignore[override]
        return self.compare("ne", other)

    def __lt__(self, other):
        return self.compare("lt", other)

    def __le__(self, other):
        return self.compare("le", other)

    def __gt__(self, other):
        return self.compare("gt", other)

    def __ge__(self, other):
        return self.compare("ge", other)

    def map_value(self, f: Callable[[Column], Column] | str, defragment: bool = False) -> SegmentFrame:
        """``f`` (a Column function, or a name of ``functions.values.UNARY``) of every value."""
        out = self._valued((UNARY[f] if isinstance(f, str) else f)(F.col("value")))
        return out.coalesce() if defragment else out

    def equal(self, other: SegmentFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
        """One row, ``equal``: same keys and runs, and values that are close (NaN to NaN, an infinity only to itself)."""
        if self.keys != other.keys:
            return self.df.sparkSession.range(1).select(F.lit(False).alias("equal"))
        at = [*self.keys, "seg_start", "seg_end"]
        met = self.df.withColumnRenamed("value", "a").join(other.df.withColumnRenamed("value", "b"), at, "full_outer")
        both_finite = (F.abs(F.col("a")) < INF) & (F.abs(F.col("b")) < INF)
        close = (F.col("a") == F.col("b")) | (both_finite & (F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs(F.col("b"))))
        return met.agg(F.coalesce(F.bool_and(F.coalesce(close & (F.isnan("a") == F.isnan("b")), F.lit(False))), F.lit(True)).alias("equal"))

    # ---- lookup ---------------------------------------------------------------------------------------------------

    def at(self, pos: int) -> DataFrame:
        """Each key's value at ``pos``; 0.0 past its end."""
        if pos < 0:
            raise ValueError("positions are not negative")
        hit = F.max(F.when((F.col("seg_start") <= pos) & (F.col("seg_end") > pos), F.col("value")))
        return self.df.groupBy(*self.keys).agg(F.coalesce(hit, F.lit(0.0)).alias("value"))

    def at_many(self, points: DataFrame, pos: str = "pos") -> DataFrame:
        """``points`` (the keys and ``pos``, repeats and all) with their values, 0.0 where there is none: a sweep, not a range join."""
        asked = points.groupBy(*self.keys, F.col(pos).cast("long").alias("p")).agg(F.count("*").alias("n"))
        each = F.array(F.struct(F.col("seg_start").alias("p"), F.col("value").alias("v"), F.lit(True).alias("s")), F.struct(F.col("seg_end").alias("p"), F.lit(0.0).alias("v"), F.lit(False).alias("s")))
        runs = self.df.select(*self.keys, F.explode(each).alias("e")).select(*self.keys, "e.*")
        runs = runs.groupBy(*self.keys, "p").agg(F.coalesce(F.max(F.when(F.col("s"), F.col("v"))), F.max("v")).alias("v"), F.lit(None).cast("long").alias("n"))
        both = runs.unionByName(asked.withColumn("v", F.lit(None).cast("double"))).groupBy(*self.keys, "p").agg(F.max("v").alias("v"), F.max("n").alias("n"))
        found = scan(both, self.keys, "p", fills=("v",), tile=self.tile).where("n IS NOT NULL")
        return found.select(*self.keys, F.col("p").alias(pos), F.coalesce("v_fill", F.lit(0.0)).alias("value"), F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")

    def slice(self, begin: int | None = None, end: int | None = None) -> SegmentFrame:
        """Positions ``[begin, end)`` of every vector, counted from 0 again."""
        begin = begin or 0
        if begin < 0 or end is not None and end < begin:
            raise ValueError("a slice needs 0 <= begin <= end")
        stop = F.col("seg_end") if end is None else F.least(F.col("seg_end"), F.lit(end).cast("long"))
        cut = self.df.select(*self.keys, (F.greatest("seg_start", F.lit(begin).cast("long")) - begin).alias("seg_start"), (stop - begin).alias("seg_end"), "value")
        return self._new(cut.where("seg_end > seg_start")).coalesce()

    def lookup(self, intervals: DataFrame, bin_width: int | None = None) -> DataFrame:
        """One row for each query interval and run that it overlaps: ``Start, End, ID, Run, Value`` by key.

        ``intervals``: keys, ``start, end`` and, if it is there, ``ordinal``, which numbers a key's queries from 0. Both sides are dealt to
        bins of positions, and each pair is kept in the bin of its overlap's start, so that long keys spread over tasks. Bins are
        ``bin_width`` wide, or else 16 mean runs or a mean query, whichever is more: then the queries' and runs' places in bins are at most
        three times as many as they. Queries are numbered in tiles if their ordinals are whole numbers, else a key's in one task.
        """
        bad = (F.col("start") < 0) | (F.col("end") < F.col("start"))
        asked = intervals.select(*self.keys, F.when(bad, F.raise_error(F.lit("intervals need 0 <= start <= end")).cast("long")).otherwise(F.col("start").cast("long")).alias("Start"), F.col("end").cast("long").alias("End"), *([F.col("ordinal")] if "ordinal" in intervals.columns else [F.monotonically_increasing_id().alias("ordinal")]))
        s, e, a, b, top = (F.col(c) for c in ("Start", "End", "seg_start", "seg_end", "_top"))
        runs = self.df.agg(F.coalesce(F.max(b), F.lit(0)).alias("_top"), F.avg(b - a).alias("_run"))
        facts = asked.crossJoin(F.broadcast(runs)).agg(F.max("_top").alias("_top"), F.max("_run").alias("_run"), F.avg(F.greatest(F.least(e, top) - s, F.lit(0))).alias("_asked"))
        width = F.lit(bin_width) if bin_width else F.ceil(F.greatest(F.col("_run") * 16, "_asked", top / 2**20, F.lit(1.0)))
        facts = F.broadcast(facts.select(F.coalesce(top, F.lit(0)).alias("_top"), F.coalesce(width.cast("long"), F.lit(1)).alias("_width")))
        if "ordinal" in intervals.columns and intervals.schema["ordinal"].dataType.typeName() in ("byte", "short", "integer", "long"):
            asked = number(asked, self.keys, "ordinal", "ID")
        else:
            asked = scan(asked.withColumn("one", F.lit(1.0)), self.keys, "ordinal", sums=("one",)).withColumn("ID", F.col("one_sum").cast("long"))
        bin_of = lambda pos: F.call_function("div", pos, F.col("_width"))
        bins = lambda lo, hi: F.explode(F.sequence(bin_of(lo), bin_of(F.greatest(hi - 1, lo)))).alias("bin")
        asked = asked.crossJoin(facts).select(*self.keys, "Start", "End", "ID", "_width", bins(s, F.least(e, top)))
        dealt = self.df.crossJoin(facts).select(*self.keys, *SEGMENT, bins(a, b))
        met = asked.join(dealt, [*self.keys, "bin"]).where(((s < e) & (a < e) & (s < b)) | ((s == e) & (a <= s) & (s < b)))
        met = met.where(F.col("bin") == bin_of(F.greatest(s, a)))
        return met.select("chromosome", "Start", "End", "ID", (F.least(e, b) - F.greatest(s, a)).alias("Run"), F.col("value").alias("Value"), *self.keys[1:])

    def select_keys(self, chromosome: str | None = None, strand: str | None = None) -> SegmentFrame:
        if strand is not None and not self.stranded:
            raise KeyError("these vectors have no strands")
        own = F.lit(True) if chromosome is None else F.col("chromosome") == chromosome
        own = own if strand is None else own & (F.col("strand") == strand)
        return self._new(self.df.where(own), None if self._names is None else self._names.where(own))

    def __getitem__(self, key):
        """A position, positions, a slice, a frame of intervals, a strand, a chromosome, or both."""
        if isinstance(key, bool):
            raise IndexError(f"cannot look up {key!r}")
        if isinstance(key, int):
            return self.at(key)
        if isinstance(key, slice):
            return self.slice(key.start, key.stop)
        if isinstance(key, list):
            points = F.array(*[F.lit(int(p)).cast("long") for p in key]) if key else F.array().cast("array<bigint>")
            return self.at_many(self.df.select(*self.keys).distinct().withColumn("pos", F.explode(points)))
        if isinstance(key, DataFrame):
            return self.lookup(key)
        if isinstance(key, tuple) and len(key) == 2:
            return self.select_keys(*key)
        if isinstance(key, str):
            return self.select_keys(strand=key) if self.stranded and key in ("+", "-") else self.select_keys(key)
        raise IndexError(f"cannot look up {key!r}")

    # ---- transformations --------------------------------------------------------------------------------------------

    def defragment(self, numbers_only: bool = False) -> SegmentFrame:
        """Coalesced, with -0.0 as 0.0; first made finite if asked."""
        frame = self._valued(finite(F.col("value"))) if numbers_only else self
        return frame._valued(F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))).coalesce()

    def numbers_only(self, nan: float = 0.0, posinf: float = 2147483647.0, neginf: float = -2147483648.0) -> SegmentFrame:
        return self._valued(finite(F.col("value"), nan, posinf, neginf)).defragment()

    def length(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.max("seg_end").alias("length"))

    def shift(self, distance: int = 1, preserve_length: bool = True, fill: float = 0.0) -> SegmentFrame:
        """Moved right (left if negative); what is opened is ``fill``, what leaves is cut off (at the right only if the length is kept)."""
        if not distance:
            return self.copy()
        d = F.lit(int(distance)).cast("long")
        size = self.length()
        moved = self.df.join(size, self.keys).select(*self.keys, "length", F.greatest(F.col("seg_start") + d, F.lit(0)).alias("seg_start"), (F.col("seg_end") + d).alias("seg_end"), "value")
        end = F.least(F.col("seg_end"), F.col("length")) if preserve_length else F.col("seg_end")
        moved = moved.withColumn("seg_end", end).where("seg_end > seg_start").select(*self.keys, *SEGMENT)
        if distance > 0:
            top = F.least(d, F.col("length")) if preserve_length else d
            opened = size.select(*self.keys, F.lit(0).cast("long").alias("seg_start"), top.alias("seg_end"), F.lit(float(fill)).alias("value"))
        else:
            opened = size.select(*self.keys, F.greatest(F.col("length") + d, F.lit(0)).alias("seg_start"), F.col("length").alias("seg_end"), F.lit(float(fill)).alias("value"))
        moved = moved if distance < 0 and not preserve_length else moved.unionByName(opened.where("seg_end > seg_start"))
        return self._new(moved).coalesce()

    def make_strands_same_length(self, fill_value: float = 0.0) -> SegmentFrame:
        """Each chromosome's shorter strand filled up to the longer."""
        if not self.stranded:
            return self.copy()
        own = self.length()
        longest = own.groupBy("chromosome").agg(F.max("length").alias("longest"))
        short = own.join(longest, "chromosome").where("length < longest")
        filled = self._new(self.df.unionByName(short.select(*self.keys, F.col("length").alias("seg_start"), F.col("longest").alias("seg_end"), F.lit(float(fill_value)).alias("value"))))
        return filled if fill_value != fill_value else filled.coalesce()

    def add_pseudocounts(self, pseudo: float = 0.01) -> SegmentFrame:
        return self._valued(F.when(F.col("value") == 0, F.lit(float(pseudo))).otherwise(F.col("value"))).coalesce()

    # ---- functions of the caller's -------------------------------------------------------------------------------------

    def apply(self, f: Callable, defragment: bool = True, **kwargs) -> SegmentFrame:
        """``f`` maps a key's (runs, values), numpy arrays in order, to new ones. A key's vector is handed over whole."""
        import numpy as np
        import pyarrow as pa

        keys = self.keys

        def one(key: tuple, rows: pa.Table) -> pa.Table:
            start, end, value = (rows[c].to_numpy() for c in SEGMENT)
            order = np.argsort(start)
            runs, values = f((end - start)[order], value[order], **kwargs)
            runs, values = np.asarray(runs, np.int64), np.asarray(values, np.float64)
            if len(runs) != len(values):
                raise ValueError("runs and values differ in length")
            runs, values = runs[runs > 0], values[runs > 0]
            ends = np.cumsum(runs)
            columns = [pa.array([k.as_py()] * len(runs), pa.string()) for k in key] + [pa.array(c) for c in (ends - runs, ends, values)]
            return pa.Table.from_arrays(columns, names=[*keys, *SEGMENT])

        out = self._new(self.df.groupBy(*keys).applyInArrow(one, self.df.schema))
        return out.coalesce() if defragment else out

    def apply_values(self, f: Callable, defragment: bool = True, **kwargs) -> SegmentFrame:
        """``f`` maps a key's values to as many new ones."""
        return self.apply(lambda runs, values: (runs, f(values, **kwargs)), defragment)

    def apply_runs(self, f: Callable, defragment: bool = True, **kwargs) -> SegmentFrame:
        """``f`` maps a key's run lengths to as many new ones; positions follow."""
        return self.apply(lambda runs, values: (f(runs, **kwargs), values), defragment)

    # ---- summaries and keys ----------------------------------------------------------------------------------------------

    def run_count(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count("*").alias("runs"))

    def _sums(self) -> DataFrame:
        n = F.col("seg_end") - F.col("seg_start")
        return self.df.groupBy(*self.keys).agg(F.count("*").alias("runs"), F.sum(n).alias("length"), F.sum("value").alias("total"), F.sum(F.col("value") * n).alias("weighted"), F.sum(F.col("value") * F.col("value") * n).alias("squares"))

    def mean(self) -> DataFrame:
        """``mean``: the runs' values summed, over the length; ``weighted_mean``: the mean over positions."""
        return self._sums().select(*self.keys, divide(F.col("total"), F.col("length").cast("double")).alias("mean"), divide(F.col("weighted"), F.col("length").cast("double")).alias("weighted_mean"))

    def std(self) -> DataFrame:
        """``std``: the size of the values' summed differences from ``mean``, over the root of length - 1; ``weighted_std``: the deviation over positions."""
        s, n = self._sums(), F.col("length").cast("double")
        odd = F.abs(F.col("total") - F.col("runs") * divide(F.col("total"), n))
        weighted = F.sqrt(F.greatest(F.lit(0.0), divide(F.col("squares") - divide(F.col("weighted") * F.col("weighted"), n), n - 1)))
        return s.select(*self.keys, divide(odd, F.sqrt(n - 1)).alias("std"), weighted.alias("weighted_std"))

    def average_run(self) -> DataFrame:
        return self._sums().select(*self.keys, F.round(F.col("length") / F.col("runs"), 3).alias("average_run"))

    def key_count(self) -> DataFrame:
        return self._key_rows().agg(F.count("*").alias("keys"))

    def keys_in_order(self) -> DataFrame:
        """The keys in natural order (chr2 before chr10)."""
        return self._key_rows().orderBy(natural_key(F.col("chromosome")), *self.keys)

    def chromosomes(self) -> DataFrame:
        return self._key_rows().select("chromosome").distinct().orderBy(natural_key(F.col("chromosome")), "chromosome")

    def key_sets(self, other: SegmentFrame) -> DataFrame:
        """Every key of either side with ``place``: both, left or right."""
        mine, theirs = (f._key_rows().withColumn(n, F.lit(True)) for f, n in ((self, "l"), (other, "r")))
        place = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right")
        return mine.join(theirs, self.keys, "full_outer").select(*self.keys, place.alias("place"))

    def __iter__(self) -> Iterator[tuple]:
        """(key, frame) in natural order; the keys come to the driver, the vectors stay where they are."""
        for row in self.keys_in_order().toLocalIterator():
            key = tuple(row[k] for k in self.keys)
            yield key if self.stranded else key[0], self.select_keys(*key)

    items = __iter__

    def values(self) -> Iterator[SegmentFrame]:
        return (frame for _, frame in self)

    # ---- output ------------------------------------------------------------------------------------------------------------

    def packed(self) -> DataFrame:
        """Arrays ``runs`` and ``values`` for each key."""
        runs = F.sort_array(F.collect_list(F.struct(*SEGMENT)))
        return self.df.groupBy(*self.keys).agg(runs.alias("s")).select(*self.keys, F.transform("s", lambda x: x["seg_end"] - x["seg_start"]).alias("runs"), F.transform("s", lambda x: x["value"]).alias("values"))

    def to_table(self) -> DataFrame:
        """``Chromosome[, Strand], Runs, Values`` in order."""
        names = {"chromosome": "Chromosome", "strand": "Strand"}
        out = self.df.select(*[F.col(k).alias(names[k]) for k in self.keys], (F.col("seg_end") - F.col("seg_start")).alias("Runs"), F.col("value").alias("Values"), "seg_start")
        return out.orderBy(*[names[k] for k in self.keys], "seg_start").drop("seg_start")

    def to_frame(self) -> DataFrame:
        return self.df.orderBy(*self.keys, "seg_start").select((F.col("seg_end") - F.col("seg_start")).alias("Runs"), F.col("value").alias("Values"))

    def to_ranges(self, stranded: bool | None = None) -> DataFrame:
        """Intervals of the runs that are not zero: ``Chromosome, Start, End, Score[, Strand]``."""
        frame = (self.merge_strands() if stranded is False else self).coalesce()
        strand = [F.col("strand").alias("Strand")] if frame.stranded else []
        return frame.df.where((F.col("value") != 0) | F.isnan("value")).select(F.col("chromosome").alias("Chromosome"), F.col("seg_start").alias("Start"), F.col("seg_end").alias("End"), F.col("value").alias("Score"), *strand)

    def show(self, ends: int = 5) -> str:
        """The first and last runs of the first and last key, as text."""
        keys = [tuple(r) for r in self.keys_in_order().collect()]
        out = []
        for key in dict.fromkeys([keys[0], keys[-1]] if keys else []):
            own = self.select_keys(*key).df
            head, tail = (own.orderBy(o).limit(ends).collect() for o in (F.asc("seg_start"), F.desc("seg_start")))
            n, length = own.agg(F.count("*"), F.max("seg_end")).first()
            rows = list({r["seg_start"]: r for r in [*head, *reversed(tail)]}.values())
            runs, values = ([str(x) for x in c] for c in ([r["seg_end"] - r["seg_start"] for r in rows], [r["value"] for r in rows]))
            if n > 2 * ends:
                runs.insert(ends, "..."), values.insert(ends, "...")
            widths = [max(len(a), len(b)) for a, b in zip(runs, values, strict=True)]
            lines = [" | ".join([f"{t:<6}", *(x.ljust(w) for x, w in zip(c, widths, strict=True))]) for t, c in (("Runs", runs), ("Values", values))]
            out.append("\n".join([" ".join(map(str, key)), *lines, f"Length {length}, {n} runs (average {round(length / n, 3)})"]))
        return "\n\n".join([*out, f"{len(keys)} keys"]) if out else "Empty."

    __repr__ = __str__ = lambda self: f"SegmentFrame({', '.join(self.keys)}; {self.mode})"
