"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash

#: Lengths of the n-grams, bits of a feature's number.
LENGTHS, BITS = (3, 4, 5), 18
#: Labelled rows a model is fitted on at most (in expectation), parts that are fitted apart and averaged.
FIT_ROWS, PARTS, EPOCHS = 24_000, 8, 4


def features(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of the lower-cased text, ascending; each counts once however often it occurs."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seen = np.zeros(1 << BITS, bool)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    for n in LENGTHS:
        if len(codes) < n:
            continue
        h = mixed[: len(codes) - n + 1].copy()
        for j in range(1, n):
            h *= np.uint64(0x100000001B3)
            h ^= mixed[j : len(codes) - n + 1 + j]
        h *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
        seen[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def pack(found: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.diff(found, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(4, -1).T).view(np.uint32).reshape(-1)).astype(np.int32)


@dataclass
class Model:
    """Weights already multiplied by the log-count ratios, and the intercept."""

    weights: np.ndarray
    bias: float

    def scores(self, texts) -> np.ndarray:
        """Probability of label 1; a null text scores as an empty one."""
        z = np.array([self.weights[features(t)].sum(dtype=np.float64) + self.bias for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, alpha: float = 2.0) -> np.ndarray:
    """Log ratio of the smoothed shares of toxic and clean rows with a feature; an unseen feature has 0."""
    n = max(1, n_toxic + n_clean)
    p = (toxic + alpha * n_toxic / n) / max(1e-9, n_toxic * (1 + alpha / n))
    q = (clean + alpha * n_clean / n) / max(1e-9, n_clean * (1 + alpha / n))
    return np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)).astype(np.float32)


def fit_part(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled features by adaptive gradient steps; returns weights times scale, and the bias."""
    w, g2 = np.zeros(len(scale), np.float32), np.full(len(scale), 1e-3, np.float32)
    share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    b, b2 = float(np.log(share / (1 - share))), 1.0
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = rows[k]
            x = scale[at]
            z = float(w[at] @ x) + b
            err = 1 / (1 + np.exp(-min(max(z, -50.0), 50.0))) - labels[k]
            if abs(err) < 1e-3:
                continue
            g = err * x + decay * w[at]
            g2[at] += g * g
            w[at] -= rate * 0.2 * g / np.sqrt(g2[at])
            b2 += err * err
            b -= rate * 0.2 * err / np.sqrt(b2)
    return w * scale, b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows: labels has doc_id and toxic, docs has doc_id and text.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are used; of these a hashed sample of
    about fit_rows (a bound of the fit alone: every document is scored). Log-count ratios come
    from one pass over that sample; then its parts are fitted apart by Spark tasks and averaged.
    Null texts count as empty, null labels are ignored, repeated labels count each time. With no
    labelled rows or labels of one kind the score is a constant.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select(F.col("doc_id"), (F.col("toxic") == 1).cast("int").alias("label"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
        n = known.count()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(known, n), "doc_id")
    rows = rows.select("text", "label", F.pmod(F.xxhash64("text", "doc_id"), F.lit(PARTS)).cast("int").alias("part"))

    def featurize(batches):
        import pyarrow as pa

        for b in batches:
            found = [features(t) for t in b.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([pack(f) for f in found]), b.column(1), b.column(2)], names=["at", "label", "part"])

    held = stash(rows.mapInArrow(featurize, "at binary, label int, part int"), "features")

    def count(table):
        import pyarrow as pa

        size = 1 << BITS
        n1, n0, c1, c0 = 0, 0, np.zeros(size, np.int32), np.zeros(size, np.int32)
        for at, label in zip(table.column("at"), table.column("label"), strict=True):
            f = unpack(at.as_py())
            if label.as_py():
                n1, _ = n1 + 1, np.add.at(c1, f, 1)
            else:
                n0, _ = n0 + 1, np.add.at(c0, f, 1)
        return pa.table({"n1": [n1], "n0": [n0], "c1": [c1.tobytes()], "c0": [c0.tobytes()]})

    sums = held.groupBy("part").applyInArrow(count, "n1 long, n0 long, c1 binary, c0 binary").collect()  # at most PARTS rows of fixed size
    n1, n0 = sum(r["n1"] for r in sums), sum(r["n0"] for r in sums)
    if not n1 or not n0:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if n1 == n0 else (5.0 if n1 else -5.0))
    scale = ratios(sum(np.frombuffer(r["c1"], np.int32).astype(np.float64) for r in sums), sum(np.frombuffer(r["c0"], np.int32).astype(np.float64) for r in sums), n1, n0)
    shared = held.sparkSession.sparkContext.broadcast(scale)

    def train(table):
        import pyarrow as pa

        found = [unpack(at.as_py()) for at in table.column("at")]
        w, b = fit_part(found, np.array(table.column("label").to_pylist(), np.float64), shared.value)
        return pa.table({"w": [w.astype(np.float32).tobytes()], "b": [float(b)], "n": [len(found)]})

    parts = held.groupBy("part").applyInArrow(train, "w binary, b double, n long").collect()  # at most PARTS rows of fixed size
    total = sum(r["n"] for r in parts)
    weights = sum(np.frombuffer(r["w"], np.float32).astype(np.float64) * (r["n"] / total) for r in parts)
    return Model(weights.astype(np.float32), sum(r["b"] * r["n"] / total for r in parts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus a score column (0 to 1), in place of a column of that name if docs has one; others pass through."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        return pd.Series(Model(*shared.value).scores(text))

    return docs.withColumn("score", scored(F.col("text")))
