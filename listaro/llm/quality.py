"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its emission sums the weights of the binned features
of the line itself and of the lines before and after it; transitions link
neighbours. Forward-backward gives each line's probability of being good, and
the mean weighted by line length is the document's quality.

Labels are known per document, so all lines of a training document carry its
label. The model is fitted on a bounded sample (TRAIN_DOCS labelled documents,
chosen by a hash of their id); scoring reads every whole text, one Arrow batch
at a time, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.llm.columns import numbered, restored
from listaro.staging import read_table

#: Labelled documents that the model is fitted on, at most.
TRAIN_DOCS = 4000
#: Cuts of a measure: half are quantiles of lines in good documents, half of lines in bad ones.
BINS = 16
THRESHOLD = 0.3
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!\"#$%&*+/<=>@[\\]^_`{|}~"
_STOPS = b".,;:?-'()"
MEASURES = 12


def line_measures(line: str, seen: set[str]) -> list[float]:
    """MEASURES numbers on a line; ``seen`` holds the document's lines before it."""
    data = line.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * MEASURES
    share = 1.0 / size
    pairs = n - 1 or 1
    return [
        np.log1p(size),
        (size - len(data.translate(None, _UPPER))) * share,
        (size - len(data.translate(None, _DIGITS))) * share,
        (size - len(data.translate(None, _MARKS))) * share,
        (size - len(data.translate(None, _STOPS))) * share,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / pairs if n > 1 else 1.0,
        sum(map(eq, words, words[1:])) / pairs,
        size / n,
        max(map(len, words)) * 1.0,
        float(line in seen),
        float(data[-1:] in b".!?"),
    ]


def document_measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(measures, lengths) of the non-blank lines; one blank line for a text without any."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()] or [""]
    seen: set[str] = set()
    rows = []
    for line in lines:
        rows.append(line_measures(line, seen))
        seen.add(line)
    return np.array(rows, np.float64), np.array([max(1, len(x)) for x in lines], np.float64)


def binned(measures: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Feature numbers of each line: MEASURES for itself, as many for the line before, and for the line after."""
    width = BINS + 2
    own = np.stack([np.searchsorted(cuts[m], measures[:, m], side="left") for m in range(MEASURES)], axis=1)
    before = np.vstack([np.full((1, MEASURES), width - 1), own[:-1]])
    after = np.vstack([own[1:], np.full((1, MEASURES), width - 1)])
    offset = np.arange(MEASURES) * width
    block = MEASURES * width
    return np.hstack([own + offset, before + offset + block, after + offset + 2 * block])


def good_probability(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward; emit: log-odds of good, trans[i, j]: score of j after i."""
    n = len(emit)
    scale = np.exp(trans - trans.max())
    local = np.empty((n, 2))
    local[:, 1] = 1.0 / (1.0 + np.exp(-np.clip(emit, -60, 60)))
    local[:, 0] = 1.0 - local[:, 1]
    local += 1e-300
    forward = np.empty((n, 2))
    backward = np.ones((n, 2))
    f = local[0]
    forward[0] = f / f.sum()
    for t in range(1, n):
        f = (forward[t - 1] @ scale) * local[t]
        forward[t] = f / f.sum()
    for t in range(n - 2, -1, -1):
        b = scale @ (local[t + 1] * backward[t + 1])
        backward[t] = b / b.sum()
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def fit(docs: list[tuple[np.ndarray, int]], rounds: int = 200, l2: float = 1e-3) -> dict:
    """Maximum conditional likelihood by Adam over all documents at once; docs: (measures, label)."""
    at = np.linspace(0, 1, BINS // 2 + 2)[1:-1]
    sides = [np.vstack([m for m, y in docs if y == label] or [docs[0][0]]) for label in (0, 1)]
    cuts = np.sort(np.hstack([np.quantile(side, at, axis=0).T for side in sides]), axis=1)
    features = [binned(m, cuts) for m, _ in docs]
    size = 3 * MEASURES * (BINS + 2)
    order = np.argsort([-len(f) for f in features], kind="stable")
    lens = np.array([len(features[i]) for i in order])
    labels = np.array([docs[i][1] for i in order])
    flat = np.vstack([features[i] for i in order])
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    alive = [int((lens > t).sum()) for t in range(lens.max())]
    theta = np.zeros(size + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.repeat(labels, lens)
    pairs = (lens - 1).sum()
    gold_trans = np.array([(lens[labels == 0] - 1).sum(), 0, 0, (lens[labels == 1] - 1).sum()], float)
    for step in range(1, rounds + 1):
        emit = theta[flat].sum(axis=1)
        trans = theta[size:].reshape(2, 2)
        local = np.stack([np.zeros_like(emit), emit], axis=1)
        forward = np.empty_like(local)
        backward = np.zeros_like(local)
        forward[starts] = local[starts]
        for t in range(1, len(alive)):
            at = starts[: alive[t]] + t
            prev = forward[at - 1]
            forward[at] = np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1]) + local[at]
        for t in range(len(alive) - 1, 0, -1):
            at = starts[: alive[t]] + t
            later = local[at] + backward[at]
            backward[at - 1] = np.logaddexp(later[:, :1] + trans[:, 0], later[:, 1:] + trans[:, 1])
        ends = starts + lens - 1
        z = np.logaddexp(forward[ends, 0], forward[ends, 1])
        zs = np.repeat(z, lens)
        p = np.exp(forward[:, 1] + backward[:, 1] - zs)
        grad = np.bincount(flat.ravel(), np.repeat(gold - p, flat.shape[1]), size)
        inner = np.ones(len(emit), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        joint = np.exp(forward[at - 1][:, :, None] + trans[None] + (local[at] + backward[at])[:, None, :] - zs[at][:, None, None])
        g = np.concatenate([grad, gold_trans - (joint.sum(axis=0).ravel() if pairs else 0)]) / len(docs) - l2 * theta
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        theta = theta + 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return {"cuts": cuts, "weights": theta[:size], "trans": theta[size:].reshape(2, 2)}


def score(model: dict, text: str | None) -> float:
    """Mean probability of a good line, weighted by the lines' lengths."""
    measures, lengths = document_measures(text)
    emit = model["weights"][binned(measures, model["cuts"])].sum(axis=1)
    return float(np.average(good_probability(emit, model["trans"]), weights=lengths))


def held_out(id_column):
    """True for the fifth of the documents whose labels are never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents outside the held-out fifth, chosen by a hash of the id; of contradicting labels the larger counts."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` ids, so the broadcast is bounded.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> dict:
    """Fit on at most ``most`` labelled documents; only their line measures come to the driver."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [document_measures(x.as_py())[0].astype(np.float32).ravel().tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["measures", "label"])

    rows = training_sample(docs, labels, "quality", most).mapInArrow(measured, "measures binary, label int").toArrow().to_pydict()
    found = [(np.frombuffer(m, np.float32).reshape(-1, MEASURES).astype(np.float64), y) for m, y in zip(rows["measures"], rows["label"])]
    if not found:  # nothing to learn from: every line is as likely good as bad
        return {"cuts": np.zeros((MEASURES, BINS)), "weights": np.zeros(3 * MEASURES * (BINS + 2)), "trans": np.zeros((2, 2))}
    # A fixed order, whatever order the rows came in.
    return fit(sorted(found, key=lambda x: (x[1], x[0].tobytes())))


def with_quality(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the quality score as a further (or replaced) column.

    Defined cases: null and blank texts are scored as one blank line; any other
    column passes through, whatever its name; repeated rows get the same score;
    an empty table gives an empty result; a very long text only has more lines.
    """
    kept = [f for f in docs.schema.fields if f.name != name]
    at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([score(model, x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    schema = docs.select(*[F.col(f"`{f.name}`") for f in kept]).withColumn(name, F.lit(0.0)).schema
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def drop_bad(docs: DataFrame, model: dict, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``least``; same columns, of any name. The cases are those of ``with_quality``."""
    docs, new = numbered(docs)
    return restored(with_quality(docs, model, new[text_col]).filter(F.col("score") >= least), new)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score; the cases are defined as in ``with_quality``."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, read_table(spark, f"{sf_dir}/labels.parquet"))
    scored = with_quality(docs, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
