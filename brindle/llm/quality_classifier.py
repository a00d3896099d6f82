"""Quality classifier: Bradley-Terry ranking over document features.

Preference pairs (a labelled good document over a labelled bad one) teach a
linear score by logistic loss on feature differences.  The threshold is a score
quantile: the share of bad labels among the training rows; scores are shifted so
that this quantile gets ``cut_at``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._shared import as_bytes, cut, held_out, record, schemas, slim, table

#: Labelled rows that the fit uses at most; those with the smallest hashes of their ids.
SAMPLE = 8_000
#: Columns of the matrix of all preference pairs that are worked on at once.
BLOCK = 512
CUT_AT = 0.3
_SETS = [b"#*$%&", b"|<>", b"!?", b".,;:", b"0123456789", b"@/_=+\\{}[]()"]
_TABLES = [bytes(b for b in range(256) if b not in s) for s in _SETS]
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
N_FEATURES = 20


def features(data: bytes) -> np.ndarray:
    """Numbers of one whole text; all finite, an empty text too."""
    words = data.split()
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = [len(data.translate(None, t)) for t in _TABLES]
    upper = len(data.translate(None, _UPPER))
    distinct = len(set(words))
    triples = max(n - 2, 0)
    seen = len(set(zip(words, words[1:], words[2:], strict=False)))
    letters = sum(map(len, words))
    ends = sum(w[-1] in b"!#*$%&|" for w in words)
    short = sum(len(w) < 3 for w in words)
    per = lambda x, y: x / y if y else 0.0
    return np.array(
        [np.log1p(n), np.log1p(size), *[np.sqrt(per(c, size)) for c in counts], np.sqrt(per(upper, size)), per(distinct, n), 1 - per(seen, triples), 1 - per(len(set(lines)), len(lines)), per(letters, n) / 10, per(ends, n), per(short, n), np.log1p(per(n, len(lines))), float(n < 20), float(n < 50), np.sqrt(per(counts[3], n)), float(n == 0)]
    )


def _measure(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield record(schema, [*batch.columns[:-1], rows])


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the mean logistic loss over all pairs (a good row preferred to a bad one).

    A pair's difference enters both as products of its two rows, so sums over
    one side are enough; the matrix of pairs is made block by block.
    """
    a, b = good @ w, bad @ w
    gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
    over_bad = np.zeros(len(good))
    for at in range(0, len(bad), BLOCK):
        rows = bad[at : at + BLOCK]
        miss = 1 / (1 + np.exp(np.clip(a[:, None] - b[None, at : at + BLOCK], -30, 30)))
        gradient += miss.sum(axis=0) @ rows - good.T @ miss.sum(axis=1)
        weight = miss * (1 - miss)
        over_bad += weight.sum(axis=1)
        cross = good.T @ weight @ rows
        hessian += (rows.T * weight.sum(axis=0)) @ rows - cross - cross.T
    hessian += (good.T * over_bad) @ good
    n = len(good) * len(bad)
    return gradient / n, hessian / n


def fit(x: np.ndarray, y: np.ndarray, cut_at: float = CUT_AT, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and shift from features and 0/1 labels; every pair of unlike labels counts.

    Without both labels the weights are 0 and every score is the same, on the
    side of ``cut_at`` of the only label.
    """
    mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
    scale = x.std(axis=0) if len(x) else np.ones(N_FEATURES)
    scale[scale < 1e-9] = 1.0
    logit = np.log(cut_at / (1 - cut_at))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return mean, scale, np.zeros(x.shape[1] if x.ndim == 2 else N_FEATURES), float(logit + (1.0 if len(good) or not len(bad) else -1.0))
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps on the pairwise logistic loss
        gradient, hessian = pair_sums(z[good], z[bad], w)
        step = np.linalg.solve(hessian + ridge * np.eye(len(w)), gradient + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    score = z @ w
    # Between the scores on both sides of the quantile, so that neither side sits on it.
    ordered = np.sort(score)
    at = min(max(len(bad), 1), len(ordered) - 1)
    return mean, scale, w, float(logit - (ordered[at - 1] + ordered[at]) / 2)


def _score(batches: Iterator[pa.RecordBatch], model: tuple, cut_at: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    mean, scale, w, shift = model
    for batch in batches:
        x = np.array(batch.column(2).to_pylist(), float).reshape(-1, len(w))
        score = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w + shift, -30, 30)))
        yield record(schema, [batch.column(0), batch.column(1), score, (score >= cut_at).astype(np.int32)])


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", parts: int = 5, part: int = 0, sample: int = SAMPLE, cut_at: float = CUT_AT) -> DataFrame:
    """Quality of every whole text; one row per input row.

    Columns: ``key``, ``held_out`` (crc32 of the key as text modulo ``parts``
    is ``part``), ``score`` (0 to 1), ``predicted`` (score >= ``cut_at``).

    The fit uses at most ``sample`` labelled rows that are not held out, chosen
    by a hash of the key; features are computed from the text alone.  Null and
    empty texts have features too; null keys are scored and never train;
    repeated rows give repeated results; missing or null labels are left out;
    without both labels all scores are equal; an empty table gives an empty one.
    """
    source = docs.select(F.col(f"`{key}`").alias("__key"), held_out(F.col(f"`{key}`"), parts, part).alias("held_out"), as_bytes(f"`{text}`").alias("text"))
    schema, arrow = schemas(source.schema.fields[:2], "x array<double>")
    measured = cut(source.mapInArrow(slim(lambda it: _measure(it, arrow)), schema), "features")
    known = labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("y")).filter("y in (0, 1)")
    rows = measured.filter(~F.col("held_out")).join(known, "__key").orderBy(F.xxhash64("__key"), "__key", "y").limit(sample).select("x", "y").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, N_FEATURES)
    model = fit(x, np.array([r["y"] for r in rows]), cut_at=cut_at)
    out, arrow_out = schemas(measured.schema.fields[:2], "score double, predicted int")
    return measured.mapInArrow(lambda it: _score(it, model, cut_at, arrow_out), out).withColumnRenamed("__key", key)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLE: dict[str, str] = {}
