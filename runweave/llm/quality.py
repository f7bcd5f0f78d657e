"""Quality classifier by compression: two zstandard dictionaries, one calibrated difference.

A text is cut into blocks of ``BLOCK`` bytes; every block is compressed once with a dictionary
made from good text and once with one made from bad text. The difference of the two sums, over
the bytes of the text, is high where the text resembles good text. As a few bytes tell little, each text
counts ``PSEUDO_BYTES`` more of the labelled rows' mean difference. A one-variable logistic fit
on labelled rows that the dictionaries did not see turns the result into a probability.

Every row is scored from its whole text and from nothing else. Results by case: null or empty
text scores the calibration's value at the mean difference; repeated rows get equal scores; ties at 0.5
count as label 1; an empty table gives an empty result; columns of the input named ``score`` or
``predicted`` are replaced; without both labels in the training rows the score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, replaces

#: Rows of each label used to fit; the first by a hash of the id. The only sample there is.
FIT_ROWS = 2000
BLOCK = 1024
PSEUDO_BYTES = 64
DICTIONARY_BYTES = 65536
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    mean: float = 0.0

    def differences(self, texts: list[str | None]) -> np.ndarray:
        import zstandard

        good, bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(level=LEVEL) for d in (self.good, self.bad))
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "surrogatepass")
            more = 0
            for at in range(0, len(raw), BLOCK):
                block = raw[at : at + BLOCK]
                more += len(bad.compress(block)) - len(good.compress(block))
            out[i] = (more + PSEUDO_BYTES * self.mean) / (len(raw) + PSEUDO_BYTES)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -40, 40)))


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    blocks = [raw[i : i + BLOCK] for raw in (t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(raw), BLOCK)]
    blocks = [b for b in blocks if len(b) >= 8]
    size = min(DICTIONARY_BYTES, sum(map(len, blocks)) // 4)
    if len(blocks) >= 8 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, blocks).as_bytes()
        except zstandard.ZstdError:  # too few or too uniform samples for the trainer
            pass
    return b"".join(blocks)[:DICTIONARY_BYTES] if sum(map(len, blocks)) >= 8 else b""


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic regression by Newton steps, lightly shrunk."""
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-9)
    design, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        slope = design.T @ (weight * (y - p)) - np.array([1e-3, 0.0]) * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, hold: int | None = 1, k: int = 3, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on ``labels`` (doc_id, quality) outside fold ``hold`` of ``k`` (None: on all).

    At most ``fit_rows`` ids of each label are chosen, the first by a hash of the id, before any text
    is read; only their texts are fetched. The prior comes from all labels.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.where(fold("doc_id", k) != hold) if hold is not None else marks
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("label"))
    totals = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.col("doc_id")]
    texts: dict[int, list[str]] = {}
    for value in (0, 1):
        chosen = marks.where(F.col("label") == value).orderBy(*order).limit(fit_rows).select("doc_id")
        own = docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")  # fit_rows ids at most
        texts[value] = list(dict.fromkeys(r["text"] for r in own.orderBy(*order, "text").limit(fit_rows).collect()))
    if not texts[0] or not texts[1]:
        n, ones = sum(totals.values()), totals.get(1, 0)
        return QualityModel(b"", b"", 0.0, float(np.log((ones + 0.5) / (n - ones + 0.5))))
    # Half of a class makes its dictionary, the other half calibrates; then the halves change places, so that
    # the calibration sees as many rows as there are. The dictionaries that stay come from the first halves.
    half = {v: (t[::2], t[1::2] or t[::2]) for v, t in texts.items()}
    model = QualityModel(_dictionary(half[1][0]), _dictionary(half[0][0]), 0.0, 0.0)
    held = [(t, v) for v in (0, 1) for t in half[v][1]]
    y = np.array([v for _, v in held], float)
    weight = np.array([totals[v] / len(half[v][1]) for _, v in held])
    size = np.array([len(t.encode("utf-8", "surrogatepass")) for t, _ in held])
    mean = float(np.average(model.differences([t for t, _ in held]) * (size + PSEUDO_BYTES) / size, weights=weight))
    model = QualityModel(model.good, model.bad, 0.0, 0.0, mean)
    slope, offset = _logistic(model.differences([t for t, _ in held]), y, weight * len(held) / weight.sum())
    return QualityModel(model.good, model.bad, slope, offset, mean)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher for label 1) and ``predicted`` (1 from 0.5 on)."""
    base = replaces(docs, ["score", "predicted"])
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = base.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                score = model.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return base.mapInArrow(scored, schema)

