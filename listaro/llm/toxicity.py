"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space made single, and the presence of each of
its n-grams of code points is a feature, hashed into 2^BITS slots. The slots'
log-count ratios between toxic and other training texts scale the features, and
a logistic regression is trained on the scaled ones, both classes weighing the
same. Features that fewer than LEAST_DOCS training texts have, or whose ratio is
within LEAST_RATIO of zero, are not used.

The model is fitted on a bounded sample (TRAIN_DOCS labelled documents, chosen
by a hash of their id); scoring reads every whole text, one Arrow batch at a
time, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.llm.quality import held_out, training_sample
from listaro.staging import drop_stage, read_table, stage

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCS = 6000
BITS = 21
ORDERS = (5, 7)
LEAST_DOCS = 8
LEAST_RATIO = 1.0
THRESHOLD = 0.5
#: Code points of a text that are hashed at once.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _hashed(points: np.ndarray) -> np.ndarray:
    """The sorted slots of the n-grams of a run of code points."""
    found, done = [], 0
    code = np.zeros(len(points), np.uint64)
    for order in ORDERS:
        n = len(points) - order + 1
        if n < 1:
            break
        # Extend the hash of the shorter n-grams point by point.
        code = code[:n].copy()
        for i in range(done, order):
            code *= _BASE
            code += points[i : n + i]
        done = order
        found.append((((code ^ (code >> np.uint64(31))) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def ngram_slots(text: str | None) -> np.ndarray:
    """The sorted slots of the n-grams that the text has; a blank text has none. A very long text is read in pieces that overlap."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.int32)
    joined = f" {' '.join(words)} "
    parts = []
    for begin in range(0, len(joined), PIECE):
        piece = joined[begin : begin + PIECE + max(ORDERS) - 1]
        parts.append(_hashed(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def ratios(p: np.ndarray, q: np.ndarray, toxic: int, other: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(used, ratio): which slots are features, and their log-count ratios; p and q: toxic and other texts, of so many, that have the slot."""
    ratio = np.log((p + alpha) / (toxic + 2 * alpha)) - np.log((q + alpha) / (other + 2 * alpha))
    return (p + q >= LEAST_DOCS) & (np.abs(ratio) >= LEAST_RATIO), ratio


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 200, l2: float = 20.0, alpha: float = 1.0) -> dict:
    """Log-count ratios of rows of slots, then the regression of ``fit_places``."""
    size = 1 << BITS
    p, q = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row, label in zip(rows, labels):
        (p if label == 1 else q)[row] += 1
    used, ratio = ratios(p, q, int((labels == 1).sum()), int((labels == 0).sum()), alpha)
    slots = np.flatnonzero(used)
    return fit_places([np.searchsorted(slots, r[used[r]]).astype(np.int32) for r in rows], labels, slots, ratio[slots], rounds, l2)


def fit_places(rows: list[np.ndarray], labels: np.ndarray, slots: np.ndarray, ratio: np.ndarray, rounds: int = 200, l2: float = 20.0) -> dict:
    """Logistic regression by Adam; ``rows`` hold places in ``slots``, the features. Both classes have half of the weight, so that the rarer one is found too."""
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    flat, size = np.concatenate(rows) if rows else np.empty(0, np.int32), len(slots)
    weight, bias = np.zeros(size), 0.0
    share = max(1, (labels == 1).sum()) / len(rows)
    importance = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1 / len(rows)))
    scale = ratio[flat]
    m1, m2, b1, b2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(owner, weight[flat] * scale, len(rows)) + bias
        miss = (labels - 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))) * importance
        g = np.bincount(flat, miss[owner] * scale, size) - l2 * weight
        gb = miss.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        rate = 0.02
        weight += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        bias += rate * (b1 / (1 - 0.9**step)) / (b2**0.5 / (1 - 0.999**step) ** 0.5 + 1e-8)
    full = np.zeros(1 << BITS, np.float32)
    full[slots] = weight * ratio
    return {"weight": full, "bias": bias}


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> dict:
    """Fit on at most ``most`` labelled documents. Their slots stay with the executors; counts of slots, at most 2^BITS, and the places of the features come to the driver."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [ngram_slots(x.as_py()).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["slots", "label"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for row, label in zip(batch.column(0), batch.column(1).to_pylist()):
                both[int(label == 1)][np.frombuffer(row.as_py(), np.int32)] += 1
        at = np.flatnonzero(both.any(axis=0))
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(both[1][part]), pa.array(both[0][part])], ["slot", "p", "q"])

    known = stage(training_sample(docs, labels, "toxic", most).mapInArrow(slots, "slots binary, label int"), "toxicity-slots", rebalance=False)
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n:  # nothing to learn from
        return {"weight": np.zeros(1 << BITS, np.float32), "bias": 0.0}
    seen = known.mapInArrow(counted, "slot int, p int, q int").groupBy("slot").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    often = seen.filter(F.col("p") + F.col("q") >= LEAST_DOCS).toArrow()
    slot, p, q = (often[c].to_numpy() for c in ("slot", "p", "q"))
    order = np.argsort(slot)
    slot, p, q = slot[order], p[order], q[order]
    used, ratio = ratios(p, q, n.get(1, 0), n.get(0, 0))
    features, ratio = slot[used], ratio[used]
    place = np.full(1 << BITS, -1, np.int32)
    place[features] = np.arange(len(features))
    shared = docs.sparkSession.sparkContext.broadcast(place)  # 8 MB, whatever the input

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value[np.frombuffer(x.as_py(), np.int32)] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[r >= 0].tobytes() for r in rows], pa.binary()), batch.column(1)], ["places", "label"])

    # A fixed order, whatever order the rows came in.
    table = known.mapInArrow(placed, "places binary, label int").toArrow()
    drop_stage(known)
    found = sorted(((np.frombuffer(s.as_py(), np.int32), y.as_py()) for s, y in zip(table["places"], table["label"])), key=lambda x: (x[1], x[0].tobytes()))
    return fit_places([s for s, _ in found], np.array([y for _, y in found]), features, ratio)


def score(model: dict, text: str | None) -> float:
    z = float(model["weight"][ngram_slots(text)].sum()) + model["bias"]
    return float(1.0 / (1.0 + np.exp(-min(40.0, max(-40.0, z)))))


def with_toxicity(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic as a further (or replaced) column.

    Defined cases: null and blank texts have no n-gram and get the score of the
    bias alone; other columns pass through, whatever their names; repeated
    rows get the same score; an empty table gives an empty result; a very long
    text is read in pieces.
    """
    kept = [f for f in docs.schema.fields if f.name != name]
    at = [f.name for f in kept].index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([score(shared.value, x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    return rows.mapInArrow(run, rows.withColumn(name, F.lit(0.0)).schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score; the cases are defined as in ``with_toxicity``."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, read_table(spark, f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
