"""Worked examples, edge cases, and random vectors against a dense numpy model."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.functions.values import UNARY
from runweave.operators.frame import SegmentFrame
from runweave.plans.segments import coalesce_exact, coalesce_near
from runweave.sources.tables import read_runs_csv, write_runs_csv
from runweave.streaming.coverage import deltas, from_deltas

NAN, INF = float("nan"), float("inf")


def frames(spark, cases, **how):
    """Keyed vectors from {key: (runs, values)}."""
    rows = [(k, i, int(r), float(v)) for k, (runs, values) in cases.items() for i, (r, v) in enumerate(zip(runs, values, strict=True))]
    return SegmentFrame.from_runs(spark.createDataFrame(rows, "chromosome string, o int, Runs long, Values double"), "o", **how)


def vectors(frame):
    """{key: (runs, values)}; also checks that segments tile their vector."""
    out = {}
    for r in sorted(frame.df.collect(), key=lambda r: (*(r[k] for k in frame.keys), r["seg_start"])):
        key = r["chromosome"] if not frame.stranded else (r["chromosome"], r["strand"])
        runs, values, end = out.setdefault(key, ([], [], [0]))
        assert r["seg_start"] == end[0] < r["seg_end"]
        runs.append(r["seg_end"] - r["seg_start"])
        values.append(r["value"])
        end[0] = r["seg_end"]
    return {k: (a, b) for k, (a, b, _) in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, (runs, values) in want.items():
        assert got[k][0] == list(runs), k
        assert got[k][1] == pytest.approx(list(values), rel=1e-6, nan_ok=True), k


def dense(runs, values):
    return np.repeat(np.array(values, float), runs)


def encode(x):
    if not len(x):
        return [], []
    new = np.concatenate([[True], ~((x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1])))])
    at = np.flatnonzero(new)
    return np.diff([*at, len(x)]).tolist(), x[at].tolist()


ABC = {"a": ([1, 2], [0, 1]), "b": ([1, 2, 1, 5], [0, 2.1, 3, 4]), "c": ([3, 4], [5, 6])}
XYZ = {"a": ([2, 2], [2, 3]), "b": ([3, 2, 2, 1, 1, 1], [1, 0, 2, 3, 4, 2]), "d": ([2], [7])}


@pytest.mark.parametrize("name,want", [
    ("add", {"a": ([1, 1, 1, 1], [2, 3, 4, 3])}), ("sub", {"a": ([1, 1, 1, 1], [-2, -1, -2, -3]), "b": ([1, 2, 1, 1, 2, 1, 1, 1], [-1, 1.1, 3, 4, 2, 1, 0, -2]), "c": ([3, 4], [5, 6]), "d": ([2], [-7])}),
    ("mul", {"a": ([1, 1, 1, 1], [0, 2, 3, 0]), "c": ([7], [0]), "d": ([2], [0])}), ("div", {"a": ([1, 1, 1, 1], [0, 0.5, 1 / 3, 0]), "c": ([7], [INF]), "d": ([2], [0])}),
])
def test_vector_arithmetic(spark, name, want):
    got = vectors(getattr(frames(spark, ABC), name)(frames(spark, XYZ)))
    assert got.keys() == {"a", "b", "c", "d"}
    same({k: got[k] for k in want}, want)


def test_scalars_and_functions(spark):
    x = frames(spark, {"a": ([1, 2], [0, 1]), "h": ([1, 2], [0.5, 1]), "s": ([1, 2, 3, 4], [1, 4, 9, 16])})
    values = lambda frame, k: vectors(frame)[k][1]
    assert values(x - 10, "a") == [-10, -9] and values(x / 10, "a") == [0, 0.1]
    assert values(5 + x, "h") == [5.5, 6] and values(5 - x, "h") == [4.5, 4] and values(5 * x, "h") == [2.5, 5] and values(5 / x, "h") == [10, 5]
    assert values(-x, "h") == [-0.5, -1] and vectors(x * 0)["s"] == ([10], [0])
    assert values(x.map_value("sqrt"), "s") == [1, 2, 3, 4]
    assert values(x.map_value("sqrt").map_value("log10"), "s") == pytest.approx([0, 0.30103, 0.47712, 0.60206], abs=1e-5)
    assert values(x.map_value("log10"), "a") == [-INF, 0]


def test_division_by_zero(spark):
    x = frames(spark, {k: ([1], [v]) for k, v in {"pos": 2, "neg": -2, "zero": 0, "nan": NAN, "minus": 2, "inf": INF}.items()})
    y = frames(spark, {k: ([1], [-0.0 if k == "minus" else 0.0]) for k in ("pos", "neg", "zero", "nan", "minus", "inf")})
    got = {k: v[1][0] for k, v in vectors(x / y).items()}
    assert got["pos"] == got["inf"] == INF and got["neg"] == got["minus"] == -INF and math.isnan(got["zero"]) and math.isnan(got["nan"])


@pytest.mark.parametrize("name,scalar,vector", [
    ("eq", ([1, 2, 3], [0, 1, 0]), ([6], [0])), ("ne", ([1, 2, 3], [1, 0, 1]), ([6], [1])), ("ge", ([1, 2, 3], [0, 1, 0]), ([1, 2, 2, 1], [0, 1, 0, 1])),
    ("gt", ([6], [0]), ([1, 2, 2, 1], [0, 1, 0, 1])), ("le", ([6], [1]), ([1, 2, 2, 1], [1, 0, 1, 0])), ("lt", ([1, 2, 3], [1, 0, 1]), ([1, 2, 2, 1], [1, 0, 1, 0])),
])
def test_comparisons(spark, name, scalar, vector):
    x, y = frames(spark, {"a": ([1, 2, 3], [0, 5, 1])}), frames(spark, {"a": ([2, 1, 2], [2, 3, 9])})
    same(vectors(x.compare(name, 5)), {"a": scalar})
    same(vectors(x.compare(name, y)), {"a": vector})


def test_comparisons_of_nan_and_infinity_and_overhang(spark):
    x = frames(spark, {"a": ([1, 1, 1, 1, 1], [NAN, INF, 1, 2, 2])})
    y = frames(spark, {"a": ([1, 1, 1, 1], [NAN, INF, 1, 3])})
    assert dense(*vectors(x == y)["a"]).tolist() == [0, 0, 1, 0, 0] and dense(*vectors(x != y)["a"]).tolist() == [1, 1, 0, 1, 1]
    assert dense(*vectors(x >= y)["a"]).tolist() == [0, 0, 1, 0, 1] and dense(*vectors(x < y)["a"]).tolist() == [0, 0, 0, 1, 0]


def test_transforms(spark):
    x = frames(spark, {"a": ([3, 2, 1], [1, -1, 2])})
    for args, want in [((2, False, NAN), ([2, 3, 2, 1], [NAN, 1, -1, 2])), ((2,), ([2, 3, 1], [0, 1, -1])), ((-2, True, NAN), ([1, 2, 1, 2], [1, -1, 2, NAN])), ((-4, False), ([1, 1], [-1, 2])), ((0,), ([3, 2, 1], [1, -1, 2])), ((-9,), ([6], [0])), ((9,), ([6], [0]))]:
        same(vectors(x.shift(*args)), {"a": want})
    y = frames(spark, {"a": ([1, 2, 1, 2, 1], [-INF, 1, NAN, 1, INF]), "z": ([2, 1], [-0.0, 0.0])})
    got = vectors(y.numbers_only())
    same(got, {"a": ([1, 2, 1, 2, 1], [-2147483648, 1, 0, 1, 2147483647]), "z": ([3], [0])})
    assert math.copysign(1, got["z"][1][0]) == 1
    same(vectors(frames(spark, {"a": ([1, 2, 3], [0, 0, 4])}).add_pseudocounts(0.5)), {"a": ([3, 3], [0.5, 4])})
    same(vectors(x.slice(2, 5)), {"a": ([1, 2], [1, -1])})
    assert vectors(x[7:9]) == {} and vectors(x[2:2]) == {} and vectors(x[1:])["a"][0] == [2, 2, 1]


@pytest.mark.parametrize("tile", [None, 2, 1000])
def test_anchored_tolerance(spark, tile):
    chains = {"drift": [1.0, 1.000009, 1.000018, 1.000027], "odd": [NAN, NAN, INF, INF, -INF, 0.0, 4e-6, 9e-6, 12e-6, 5.0], "down": [2.0, 1.999993, 1.999986, 1.99998]}
    cases = {k: ([1] * len(v), v) for k, v in chains.items()}

    def fold(values):
        out = []
        for v in values:
            if out and (abs(v - out[-1][1]) < 1e-5 or v == out[-1][1] or (math.isnan(v) and math.isnan(out[-1][1]))):
                out[-1][0] += 1
            else:
                out.append([1, v])
        return [n for n, _ in out], [v for _, v in out]

    raw = [(k, i, i + 1, v) for k, (_, values) in cases.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(raw, "chromosome string, seg_start long, seg_end long, value double")
    got = vectors(SegmentFrame(coalesce_near(df, ["chromosome"], tile), mode="exact"))
    same(got, {k: fold(v) for k, v in chains.items()})
    assert [r for r, _ in vectors(SegmentFrame(coalesce_exact(df, ["chromosome"], tile))).values()] == [[1] * 4, [1] * 4, [2, 2, 1, 1, 1, 1, 1, 1]]


def random_cases(seed, keys=6, special=False):
    rng = np.random.default_rng(seed)
    pool = [-2, -1, 0, 1, 2, 3] + ([NAN, INF, -INF] if special else [])
    return {f"k{i}": (rng.integers(1, 6, n := int(rng.integers(1, 9))).tolist(), rng.choice(pool, n).tolist()) for i in range(keys) if rng.random() < 0.8}


@pytest.mark.parametrize("tile", [None, 3])
@pytest.mark.parametrize("special", [False, True])
def test_random_vectors_against_dense_ones(spark, tile, special):
    a, b = random_cases(1 + special, 12, special), random_cases(11 + special, 12, special)
    x, y = (frames(spark, c, mode="exact", tile=tile) for c in (a, b))
    ops = {"add": np.add, "sub": np.subtract, "mul": np.multiply, "div": np.divide}
    for name in ("add", "div", "eq", "lt") if tile else ("sub", "mul", "div", "ne", "ge"):
        got = vectors(getattr(x, name)(y) if name in ops else x.compare(name, y))
        assert got.keys() == a.keys() | b.keys()
        for k in got:
            u, v = (dense(*c[k]) if k in c else np.zeros(0) for c in (a, b))
            n, pad = max(len(u), len(v)), NAN if name in ("eq", "ne") else 0.0
            u, v = (np.concatenate([z, np.full(n - len(z), pad)]) for z in (u, v))
            with np.errstate(all="ignore"):
                if name in ops:
                    want = ops[name](u, v)
                    want[(v == 0) & np.isnan(u)] = NAN
                else:
                    d = u - v
                    want = {"eq": d == 0, "ne": ~(d == 0), "lt": d < 0, "ge": d >= 0}[name].astype(float)
            assert np.array_equal(dense(*got[k]), want, equal_nan=True) and got[k][0] == encode(want)[0], (name, k)


def test_inverse_and_commutative_laws(spark):
    rng = np.random.default_rng(3)
    a, b = ({f"k{i}": encode(np.repeat(rng.integers(1, 1000, 8), rng.integers(1, 20, 8)).astype(float)) for i in range(20)} for _ in range(2))
    for k in a:  # equal lengths: past its end a divisor is 0
        n = sum(a[k][0]) - sum(b[k][0])
        (b if n > 0 else a)[k] = ([*(b if n > 0 else a)[k][0], abs(n)], [*(b if n > 0 else a)[k][1], 77.0]) if n else (b if n > 0 else a)[k]
    x, y = frames(spark, a), frames(spark, b)
    want = {k: encode(dense(*v)) for k, v in a.items()}
    same(vectors((x / y) * y), want)
    same(vectors((x + y) - y), want)
    assert vectors(x + y) == vectors(y + x) and vectors(x * y) == vectors(y * x)


def intervals(spark, n=200, seed=0, keys=("chr1", "chr2", "chr10")):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.choice(keys)), str(rng.choice(["+", "-"])), int(s := rng.integers(0, 300)), int(s + rng.integers(0, 40)), float(rng.integers(1, 5))) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "chromosome string, strand string, start long, end long, score double")


@pytest.mark.parametrize("tile", [None, 16])
def test_coverage_counts_positions(spark, tile):
    rows, df = intervals(spark)
    for stranded, value in ((False, None), (True, "score")):
        got = vectors(SegmentFrame.coverage(df, stranded=stranded, value_col=value, mode="exact", tile=tile))
        key = lambda r: (r[0], r[1]) if stranded else r[0]
        for k in {key(r) for r in rows}:
            own = [r for r in rows if key(r) == k]
            want = np.zeros(max(r[3] for r in own))
            for r in own:
                want[r[2] : r[3]] += r[4] if value else 1
            assert dense(*got[k]).tolist() == want.tolist()


def test_coverage_edges(spark):
    schema = "chromosome string, start long, end long"
    got = vectors(SegmentFrame.coverage(spark.createDataFrame([("a", 5, 9), ("a", 12, 12), ("b", 0, 2), (None, 1, 2), ("c", 2**33, 2**33 + 5)], schema)))
    assert got == {"a": ([5, 4, 3], [0, 1, 0]), "b": ([2], [1]), "c": ([2**33, 5], [0, 1])}
    with pytest.raises(Exception, match="0 <= start <= end"):
        SegmentFrame.coverage(spark.createDataFrame([("a", 5, 2)], schema)).df.collect()
    assert vectors(SegmentFrame.coverage(spark.createDataFrame([], schema))) == {}


def test_lookups(spark):
    rows, df = intervals(spark)
    frame = SegmentFrame.coverage(df, mode="exact")
    vec = {k: dense(*v) for k, v in vectors(frame).items()}
    assert {r["chromosome"]: r["value"] for r in frame.at(100).collect()} == {k: v[100] for k, v in vec.items()} and {r["value"] for r in frame[5000].collect()} == {0.0}
    points = [(k, p) for k in ("chr1", "chr10") for p in (0, 7, 7, 50, 299, 4000)]
    got = sorted((r["chromosome"], r["pos"], r["value"]) for r in frame.at_many(spark.createDataFrame(points, "chromosome string, pos long")).collect())
    assert got == sorted((k, p, float(vec[k][p]) if p < len(vec[k]) else 0.0) for k, p in points)
    asked = [("chr1", 10, 60, 0), ("chr1", 5, 5, 1), ("chr1", 250, 900, 2), ("chr2", 0, 400, 0), ("none", 0, 9, 0), ("chr1", 5000, 5001, 3)]
    q = spark.createDataFrame(asked, "chromosome string, start long, end long, ordinal long")
    runs = {k: (np.cumsum(v[0]) - v[0], np.cumsum(v[0]), v[1]) for k, v in vectors(frame).items()}
    want = sorted((k, s, e, i, int(min(e, b) - max(s, a)), v) for k, s, e, i in asked for a, b, v in zip(*runs.get(k, ([], [], [])), strict=True) if (s < e and a < e and s < b) or (s == e and a <= s < b))
    for bins in (None, 7):
        assert sorted(tuple(r) for r in frame.lookup(q, bin_width=bins).collect()) == want
    with pytest.raises(ValueError):
        frame.at(-1)
    with pytest.raises(ValueError):
        frame.slice(5, 2)
    with pytest.raises(IndexError):
        frame[1.5]
    with pytest.raises(KeyError):
        frame.select_keys(strand="+")
    assert sorted(r["value"] for r in frame["chr1"][[3, 3, 10**6]].collect()) == sorted([vec["chr1"][3]] * 2 + [0.0])


def test_strands(spark):
    rows, df = intervals(spark, seed=4)
    both, one = SegmentFrame.coverage(df, stranded=True), SegmentFrame.coverage(df)
    assert vectors(both.merge_strands()) == vectors(one) and vectors(both + one) == vectors(one * 2)
    lengths = {(r["chromosome"], r["strand"]): r["length"] for r in both.make_strands_same_length().length().collect()}
    assert all(lengths[k, "+"] == lengths[k, "-"] for k in ("chr1", "chr2", "chr10"))
    filled = vectors(both.make_strands_same_length(NAN))
    assert any(math.isnan(v[1][-1]) for v in filled.values())
    assert vectors(both["+"]).keys() == {(k, "+") for k in ("chr1", "chr2", "chr10")} and vectors(both["chr2", "-"]).keys() == {("chr2", "-")} and vectors(both["x"]) == {}


def test_keys_and_summaries(spark):
    frame = frames(spark, {"chr10": ([1, 2, 1], [1, 2, 3]), "chr2": ([4], [2]), "chrX": ([1], [0]), "chr1": ([1], [9])})
    assert [r[0] for r in frame.chromosomes().collect()] == ["chr1", "chr2", "chr10", "chrX"] and [k for k, _ in frame] == ["chr1", "chr2", "chr10", "chrX"]
    row = lambda df: next(r for r in df.collect() if r["chromosome"] == "chr10")
    assert row(frame.mean())["mean"] == 1.5 and row(frame.mean())["weighted_mean"] == 2 and row(frame.std())["std"] == pytest.approx(0.8660254037844386)
    assert row(frame.length())["length"] == 4 and row(frame.run_count())["runs"] == 3 and row(frame.average_run())["average_run"] == 1.333 and frame.key_count().first()["keys"] == 4
    assert frame.equal(frame.copy()).first()["equal"] and not frame.equal(frame * 2).first()["equal"] and not frame.equal(frame["chr2"]).first()["equal"]
    assert {r["chromosome"]: r["place"] for r in frame.key_sets(frames(spark, {"chr2": ([1], [1]), "y": ([1], [1])})).collect()} == {"chr1": "left", "chr2": "both", "chr10": "left", "chrX": "left", "y": "right"}
    assert "Length 1, 1 runs" in frame.show() and frame["zz"].show() == "Empty." and "near" in repr(frame)
    assert row(frame.packed()).asDict() == {"chromosome": "chr10", "runs": [1, 2, 1], "values": [1, 2, 3]}


def test_functions_of_the_callers(spark):
    x = frames(spark, {"a": ([1, 3, 5], [100, 200, -300]), "b": ([1, 4], [1, 2])})
    got = vectors(x.apply_values(np.sqrt))["a"]
    assert got[1][:2] == pytest.approx([10, 14.142135623730951]) and math.isnan(got[1][2])
    positive = lambda v: np.where(v > 0, 1, v)
    assert vectors(x.apply_values(positive, defragment=False))["a"] == ([1, 3, 5], [1, 1, -300]) and vectors(x.apply_values(positive))["a"] == ([4, 5], [1, -300])
    assert vectors(x.apply_runs(lambda r: r**2))["a"] == ([1, 9, 25], [100, 200, -300])
    assert vectors(x.apply_runs(lambda r: np.where(r % 2 == 0, r * 100, r)))["b"] == ([1, 400], [1, 2])
    assert vectors(x.apply(lambda r, v: (r[::-1], v[::-1])))["b"] == ([4, 1], [2, 1])


def test_constructors(spark):
    cells = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 1, 1, 0, 0, 2, 2, 3, 4, 2])] + [("n", 0, NAN), ("n", 1, NAN)], "chromosome string, pos long, value double")
    got = vectors(SegmentFrame.from_dense(cells))
    assert got["a"] == ([3, 2, 2, 1, 1, 1], [1, 0, 2, 3, 4, 2]) and got["n"][0] == [1, 1]
    assert vectors(frames(spark, {"a": ([2, 0, 3], [1, 9, 1])})) == {"a": ([5], [1])}
    assert SegmentFrame.empty(spark).stranded and vectors(SegmentFrame.empty(spark)) == {}
    two = SegmentFrame.from_dict({("chr1", "+"): frames(spark, {"x": ([1, 1], [1, 2])}), ("chr1", "-"): frames(spark, {"x": ([1, 1], [3, 2])})})
    assert sorted(tuple(r) for r in two.to_ranges().collect()) == [("chr1", 0, 1, 1, "+"), ("chr1", 0, 1, 3, "-"), ("chr1", 1, 2, 2, "+"), ("chr1", 1, 2, 2, "-")]
    assert [tuple(r) for r in two.to_table().collect()] == [("chr1", "+", 1, 1), ("chr1", "+", 1, 2), ("chr1", "-", 1, 3), ("chr1", "-", 1, 2)]
    with pytest.raises(ValueError):
        SegmentFrame(two.df, mode="loose")
    with pytest.raises(TypeError):
        hash(two)


def test_csv(spark, tmp_path):
    rows, df = intervals(spark, seed=2)
    frame = SegmentFrame.coverage(df, stranded=True)
    write_runs_csv(frame, str(tmp_path / "runs"))
    assert vectors(read_runs_csv(spark, str(tmp_path / "runs"))) == vectors(frame)
    (tmp_path / "plain.tsv").write_text("Chromosome\tRuns\tValues\nchr1\t2\t1.5\nchr1\t0\t3\nchr1\t3\t0\nchr2\t1\t4\n")
    assert vectors(read_runs_csv(spark, str(tmp_path / "plain.tsv"))) == {"chr1": ([2, 3], [1.5, 0]), "chr2": ([1], [4])}


def test_stream_of_intervals(spark, tmp_path):
    rows, df = intervals(spark, seed=9)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = deltas(stream, ["chromosome"]).writeStream.outputMode("complete").format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    assert vectors(from_deltas(spark.table("deltas"))) == vectors(SegmentFrame.coverage(df))


def test_plans_shuffle_once_and_read_few_columns(spark):
    from runweave import queries

    df = SegmentFrame.coverage(queries.line_intervals(spark, "/root/testdata/sf0.001"), mode="exact").df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "l_extendedprice" not in plan and "Python" not in plan
    assert isinstance(F.lit(1), type(F.col("x")))


def test_an_infinity_equals_only_itself(spark):
    def one(v):
        return SegmentFrame(spark.createDataFrame([("a", 0, 1, v)], "chromosome string, seg_start long, seg_end long, value double"))

    parts = [one(a).equal(one(b)).withColumn("want", F.lit(want)) for a, b, want in [(5.0, INF, False), (INF, 5.0, False), (-INF, INF, False), (INF, INF, True), (NAN, NAN, True), (NAN, INF, False)]]
    assert all(r["equal"] == r["want"] for r in functools.reduce(lambda x, y: x.unionByName(y), parts).collect())


def test_inverse_and_rounding_functions(spark):
    cells = spark.createDataFrame([("a", 0, 1, 0.5)], "chromosome string, seg_start long, seg_end long, value double")
    want = {"arcsin": math.asin(0.5), "arccos": math.acos(0.5), "arcsinh": math.asinh(0.5), "arctanh": math.atanh(0.5), "exp2": 2**0.5, "reciprocal": 2.0, "degrees": math.degrees(0.5), "radians": math.radians(0.5), "trunc": 0.0}
    got = cells.select(*[UNARY[n](F.col("value")).alias(n) for n in want], UNARY["trunc"](F.lit(-2.5)).alias("down")).first()
    assert all(got[n] == pytest.approx(v, rel=1e-12) for n, v in want.items()) and got["down"] == -2.0


def test_lookup_deals_one_keys_queries_and_runs_to_tiles_and_bins(spark):
    rows, df = intervals(spark, n=60, seed=5, keys=("a",))
    frame = SegmentFrame.coverage(df, mode="exact")
    rng = np.random.default_rng(7)
    asked = [("a", int(s := rng.integers(0, 400)), int(s + rng.integers(0, 30)), int(o)) for o in rng.permutation(300) * 10**6 - 10**7] + [("a", 0, 2**62, -(2**60)), ("a", 5, 5, 2**61)]
    q = spark.createDataFrame(asked, "chromosome string, start long, end long, ordinal long")
    met = frame.lookup(q)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "bin#" in join and "_tile#" in plan
    ids = {r[3]: i for i, r in enumerate(sorted(asked, key=lambda r: r[3]))}
    runs = [(r["seg_start"], r["seg_end"], r["value"]) for r in frame.df.collect()]
    want = sorted((k, s, e, ids[o], min(e, b) - max(s, a), v) for k, s, e, o in asked for a, b, v in runs if (s < e and a < e and s < b) or (s == e and a <= s < b))
    assert sorted(tuple(r) for r in met.collect()) == want


def test_lookup_in_a_selected_key_is_binned_and_asks_only_its_queries(spark):
    rows, df = intervals(spark, seed=6)
    q = df.select("chromosome", "start", "end", (F.col("start") * 1000 + F.monotonically_increasing_id() % 1000).alias("ordinal"))
    one, every = SegmentFrame.coverage(df, mode="exact")["chr2"][q], SegmentFrame.coverage(df, mode="exact").lookup(q, bin_width=10**6)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "bin#" in next(line for line in plan.splitlines() if "Join Inner" in line)
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r in every.where("chromosome = 'chr2'").collect())


ODD_INTERVALS = [("a", 5, 9), ("a", 5, 9), ("a", 0, 5), ("a", 12, 12), ("b", 0, 2), ("b", 2, 4), ("z", 0, 0), (None, 1, 2), ("c", 2**33, 2**33 + 5), ("d", 3, 3)]


def test_coverage_of_many_keys_sorts_once(spark):
    df = spark.createDataFrame(ODD_INTERVALS, "chromosome string, start long, end long")
    for mode in ("exact", "near"):
        assert vectors(SegmentFrame.coverage(df, mode=mode, repeats=False)) == vectors(SegmentFrame.coverage(df, mode=mode))
    rows, many = intervals(spark, seed=8)
    assert vectors(SegmentFrame.coverage(many, stranded=True, value_col="score", mode="exact", repeats=False)) == vectors(SegmentFrame.coverage(many, stranded=True, value_col="score", mode="exact"))
    for repeats, exchanges in ((True, 2), (False, 1)):
        plan = SegmentFrame.coverage(many, mode="exact", repeats=repeats).df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("Sort [") == 1 and ("HashAggregate" in plan) == repeats


def test_keys_of_a_coverage_need_no_segments(spark):
    df = spark.createDataFrame(ODD_INTERVALS, "chromosome string, start long, end long")
    frame = SegmentFrame.coverage(df)
    assert [r[0] for r in frame.chromosomes().collect()] == sorted({r["chromosome"] for r in frame.df.collect()}) == ["a", "b", "c", "d"]
    assert frame["b"].key_count().first()["keys"] == 1 and [k for k, _ in frame * 2] == ["a", "b", "c", "d"]
    for keys in (frame.chromosomes(), frame.keys_in_order(), frame.key_count()):
        assert "Window" not in keys._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="0 <= start <= end"):
        SegmentFrame.coverage(spark.createDataFrame([("a", 5, 2)], "chromosome string, start long, end long")).chromosomes().collect()


def test_key_sets_of_coverages_need_no_segments(spark):
    df = spark.createDataFrame(ODD_INTERVALS, "chromosome string, start long, end long")
    sets = SegmentFrame.coverage(df.where("chromosome < 'c' OR chromosome = 'z'")).key_sets(SegmentFrame.coverage(df.where("chromosome > 'a'")))
    assert {r["chromosome"]: r["place"] for r in sets.collect()} == {"a": "left", "b": "both", "c": "right", "d": "right"}
    assert "Window" not in sets._jdf.queryExecution().optimizedPlan().toString()


def test_sum_of_many_keys_aggregates_nothing(spark):
    (_, a), (_, b) = intervals(spark, seed=10), intervals(spark, seed=11, keys=("chr2", "chr10", "chr3"))
    x, y = (SegmentFrame.coverage(df, mode="exact", repeats=False) for df in (a, b))
    both = x + y
    plan = both.df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 3
    assert vectors(both) == vectors(SegmentFrame.coverage(a.unionByName(b), mode="exact"))


def test_numbering_spreads_ordinals_that_crowd_far_from_a_few_others(spark):
    from runweave.plans.scan import number

    ordinals = [*range(5000), *(10**12 + 5 * i for i in range(5000)), 2**61, -(2**60)]
    cells = [(("a", "b")[i % 7 == 0], o, min(ordinals), max(ordinals)) for i, o in enumerate(np.random.default_rng(9).permutation(np.array(ordinals)).tolist())]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = number(spark.createDataFrame(cells, "k string, o long, _lo long, _hi long"), ["k"], "o", "n")
        rows = placed.select("k", "o", "n", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want = [(k, o, i) for k in "ab" for i, o in enumerate(sorted(o for key, o, *_ in cells if key == k))]
    assert sorted((r["k"], r["o"], r["n"]) for r in rows) == want
    tasks = [r["task"] for r in rows]
    assert len(set(tasks)) == 4 and max(tasks.count(t) for t in set(tasks)) < 0.4 * len(rows)
