import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runweave.llm import pii

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) for c in d[-1::-2]]
            even = [sum(divmod(2 * int(c), 10)) for c in d[-2::-2]]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0129()5é\n_%", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y", "@@a@b..c", "x" * 3000 + "@" + "y." * 500 + "z", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111-1111 1111 4111111111111111", "+1 (499) 555-6503 +12 +1234567890123456 ++49 30 1234567", "é@b.c ü" * 3, "+1" + " " * 500])
def test_base_spans_of_hard_texts(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("unit", ["1", "a", "+", "1.", "@", "a@", "+1 ", "1 ", " dot ", "(at)", "a.", "("])
def test_long_monotone_texts_take_linear_time(unit):
    text = unit * (200_000 // len(unit))
    bases = pii.base_spans(text)
    assert isinstance(pii.proposals(text, bases), list)


@pytest.fixture(scope="module")
def rows(spark):
    import __spark_entry__ as e

    return {r["doc_id"]: r for r in e.queries()["op3_pii_candidate_boosting"](spark, SF).collect()}


def test_query_against_the_plain_patterns(spark, rows):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    for d, text in docs.items():
        own = plain(text)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        assert rows[d]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [rows[d][f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in own) for k in PLAIN]
        assert {x for x in said.split(",") if x} <= set(rows[d]["spans"].split(","))
        if not re.search("[0-9]", text or ""):
            assert rows[d]["spans"] == said


def test_disguised_data_is_found_and_other_numbers_are_not(spark):
    model = pii.fit_pii(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    hits = ["write to that.92 (at) mail2.example.com today", "reach ina[at]mail7[dot]example[dot]com now"]
    for text in hits:
        assert [s[0] for s in model.added(text, pii.base_spans(text))] == ["email"], text
    two = "paid with 4111111111111111 5500000000000004 yesterday"
    assert pii.base_spans(two) == [] and [s[0] for s in model.added(two, [])] == ["card", "card"]
    for text in ["token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "number 4111111111111112 of it", "Licensed under CC BY-NC 4.0.", "Apache License, Version 2.0", "we met at noon and ate"]:
        assert model.added(text, pii.base_spans(text)) == [], text


def test_forest_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    assert ((pii.Forest().fit(x, y).margin(x) > 0) == y).mean() > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a@b.co", 1), (2, "", 2), (3, "a@b.co", 1), (3, "a@b.co", 1)], "doc_id long, text string, spans int")
    out = pii.digest(pii.find_pii(docs, pii.fit_pii(docs))).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in out) == [(0, 1, "email:0:6"), (1, 0, ""), (2, 0, ""), (3, 1, "email:0:6"), (3, 1, "email:0:6")]
    assert pii.find_pii(docs.limit(0), pii.PiiModel()).count() == 0


def test_redact():
    assert pii.redact("a b@c.de f 1", "email:2:8,card:11:12") == "a [EMAIL] f [CARD]" and pii.redact(None, "") == ""
