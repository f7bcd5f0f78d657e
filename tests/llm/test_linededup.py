import random
import time

import pytest
from pyspark.sql import functions as F

from .compare import both
from runweave.llm import linededup

SCHEMA = "doc_id long, text string, d string, Removed int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, edits, alphabet="abé ç"):
    for _ in range(edits):
        at, kind = rng.randrange(len(line) + 1), rng.randrange(3)
        if kind == 0:
            line = line[:at] + rng.choice(alphabet) + line[at:]
        elif kind == 1:
            line = line[:at] + line[at + 1 :]
        else:
            line = line[:at] + rng.choice(alphabet) + line[at + 1 :]
    return line


def brute(docs, threshold, min_chars):
    """Kept text of every row: a line goes if an equal one, or a near one of two long ones, is before it."""
    seen = sorted({((-(2**63) if d is None else d), t, p, line) for d, t in docs if t for p, line in enumerate(t.split("\n")) if line.strip(" \t\r\x0b\x0c")}, key=lambda x: (x[0], x[2]))
    near = lambda a, b: a == b or min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold
    gone = {(d, t, p) for i, (d, t, p, line) in enumerate(seen) if any(near(line, o[3]) for o in seen[:i])}
    return [(d, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if ((-(2**63) if d is None else d), t, p) not in gone)) for d, t in docs]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("ab é") for _ in range(rng.randint(0, 60)))
        pairs.append((a, edited(rng, a, rng.randint(0, threshold + 2))))
    pairs += [("x" * 500, "x" * 498), ("a" * 3000 + "b", "b" + "a" * 3000), ("a", ""), ("", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.within(F.col("a"), F.col("b"), threshold).alias("near")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r["near"] == (distance(r["a"], r["b"]) <= threshold), (r["a"], r["b"])


def family(rng, n, size, edits):
    base = ["".join(rng.choice("abcdefg é") for _ in range(rng.randint(20, 50))) for _ in range(n)]
    return [edited(rng, b, rng.randint(0, edits)) for b in base for _ in range(size)]


@pytest.mark.parametrize("threshold,crowd", [(1, 400), (2, 400), (2, 30), (3, 400)])
def test_against_brute_force(spark, threshold, crowd):
    rng = random.Random(crowd)
    pool = family(rng, 8, 6, threshold + 1) + family(rng, 1, 12, 2 * threshold + 2)
    docs = [(i, "\n".join(rng.choice([*pool, "short", ""]) for _ in range(rng.randint(1, 6)))) for i in range(24)]
    docs += [(None, docs[3][1]), (5, docs[5][1]), (90, None), (91, ""), (92, "\n\n")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    got = linededup.dedup_lines(df, threshold, 12, crowd).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(brute(docs, threshold, 12), key=key)


def test_pipeline_form_keeps_columns_and_drops_emptied_documents(spark):
    line = "one long line that many documents of this table share"
    docs = [(1, f"{line}\nown line of the first document, long enough", "x", 1), (2, line, "x", 1), (3, f"{line}.\nshort", "x", 2), (4, "short", "x", 1), (5, None, None, None), (6, f"{line}\nsomething else that is long enough to stay here", "y", 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = linededup.deduplicate(df)
    assert got.columns == df.columns and got.schema == df.schema
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: docs[0][1], 3: "short", 5: None, 6: "something else that is long enough to stay here"}
    assert linededup.deduplicate(df.limit(0)).count() == 0


def test_long_lines(spark):
    rng = random.Random(0)
    line = "".join(rng.choice("abcdef ") for _ in range(60_000))
    docs = [(1, line), (2, line[:30_000] + "X" + line[30_000:]), (3, line[::-1]), (4, line[:20_000] + "YYY" + line[20_000:])]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    got, want = both(spark, "op5_line_dedup", f"/root/testdata/{sf}")
    assert got == want and got


def test_short_lines_and_documents_of_them(spark):
    line = "one long header line that many documents of this table share"
    docs = [(1, f"{line}\nfirst long line of a document that stays anyway\nshared"), (2, f"{line}\na verse\nof its own"), (3, f"{line}\nshared\n \t"), (4, f"{line}\na verse"), (5, f"{line}\nof its own\nand more"), (6, " \n\t\r"), (7, " \n\t\r")]
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "a verse\nof its own", 5: "and more", 6: docs[5][1], 7: docs[6][1]}


def removed(spark, lines, **how):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r["doc_id"] for r in linededup.dedup_lines(df, **how).where("n_removed > 0").collect()}


def test_many_keys_take_the_other_plan(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST", -1)
    test_against_brute_force(spark, 2, 30)


def test_crowded_keys_against_brute_force(spark):
    """Families of lines that differ in a few places of a text that all of them share, near ones among them."""
    rng = random.Random(2)
    code = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n))
    lines = []
    for size in (60, 66):
        same = code(size, "abcdefg hij")
        own = [same + code(14) if size == 60 else code(5) + same + code(5) for _ in range(80)]
        lines += own + [edited(rng, rng.choice(own), rng.randint(1, 3), "xyz") for _ in range(12)]
    want = {d for (d, t), (_, kept) in zip(enumerate(lines), brute(list(enumerate(lines)), 2, 32), strict=True) if kept != t}
    assert removed(spark, lines, crowd=60, cell=70) == want and want


def test_a_beginning_of_many_lines_takes_linear_time(spark):
    rng = random.Random(3)
    head = "Every one of these lines has this beginning "
    lines = [head + "".join(rng.choices("0123456789abcdef", k=64)) for _ in range(20_000)]
    lines += [edited(rng, lines[i], 2, "xyz") for i in range(0, 20_000, 1000)]
    begin = time.perf_counter()
    assert removed(spark, lines) == set(range(20_000, 20_020))
    assert time.perf_counter() - begin < 90
