"""Compression of vectors to one code per part, by dual-tree Lloyd rounds.

Every task cuts its vectors into blocks and builds a block's trees once; they
are staged, so each round reads them and only searches. A round moves one row
per position and entry from each task, whatever share of the parts one entry
holds, and the codebooks (positions x entries x width integers) are all that the
driver sees. See ``code_tree`` for the search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.llm import code_tree
from listaro.llm.vectors import integer_vectors
from listaro.staging import drop_stage, read_table, stage

#: Vectors of a block at most.
BLOCK = 4096

_TREE = "n int, depth int, tree_order binary, points binary, low binary, high binary, sums binary"


def _blocks(kept: DataFrame, positions: int) -> DataFrame:
    """One row per block of vectors: ids, labels, and the trees over their parts."""
    label = kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, v, labels = (batch.slice(at, BLOCK).column(c) for c in range(3))
                n = len(ids)
                parts = v.flatten().to_numpy().reshape(n, positions, -1).transpose(1, 0, 2)
                trees = code_tree.point_forest(parts)
                listed = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (ids, labels)]
                held = [x.astype(kind).tobytes() for x, kind in ((trees.order, "<i4"), (trees.points, "<i4"), (trees.low, "<i4"), (trees.high, "<i4"), (trees.sums, "<i8"))]
                yield pa.RecordBatch.from_arrays([*listed, pa.array([n], pa.int32()), pa.array([trees.depth], pa.int32()), *[pa.array([x], pa.binary()) for x in held]], ["ids", "labels", *[c.split()[0] for c in _TREE.split(", ")]])

    return kept.select("id", "v", "label").mapInArrow(run, f"ids array<bigint>, labels array<{label}>, {_TREE}")


def _forest(row: dict, positions: int) -> code_tree.Forest:
    """The trees of a staged block; its boxes and sums as they were built."""
    n, nodes = row["n"], (2 << row["depth"]) - 1
    shaped = lambda name, kind, many: np.frombuffer(row[name], kind).astype(np.int64).reshape(positions, many, -1)
    return code_tree.Forest(shaped("tree_order", "<i4", n)[:, :, 0], shaped("points", "<i4", n), shaped("low", "<i4", nodes), shaped("high", "<i4", nodes), shaped("sums", "<i8", nodes), row["depth"])


def first_books(kept: DataFrame, positions: int, entries: int) -> np.ndarray:
    """(positions, entries, width): the parts of the vectors with the smallest ids; rows without an id last, equal ids by their vectors."""
    rows = kept.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), positions, -1).transpose(1, 0, 2) if rows else np.zeros((positions, 0, 0), np.int64)


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor(sum / count) of the parts nearest to each entry; an entry without parts stays."""
    positions, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, counts, sums = code_tree.entry_forest(books), np.zeros((positions, k), np.int64), np.zeros((positions, k, width), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                found = code_tree.totals(_forest(row, positions), trees)
                counts, sums = counts + found[0], sums + found[1]
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), *[pa.array(sums[p, e, i]) for i in range(width)]], ["p", "e", "n", *[f"s{i}" for i in range(width)]])

    names = [f"s{i}" for i in range(width)]
    found = blocks.select(*[c.split()[0] for c in _TREE.split(", ")]).mapInArrow(run, "p int, e int, n bigint, " + ", ".join(f"{c} bigint" for c in names))
    new = books.copy()
    for r in found.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():
        new[r.p, r.e] = [r[c] // r.n for c in names]
    return new


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every vector."""
    positions = books.shape[0]
    label = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = code_tree.entry_forest(books) if books.size else None  # no entries, no blocks
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                forest = _forest(one.drop_columns(["ids", "labels"]).to_pylist()[0], positions)
                codes = code_tree.codes(forest, trees)
                points = np.empty_like(forest.points)
                np.put_along_axis(points, forest.order[:, :, None], forest.points, 1)
                off = points - np.take_along_axis(books, codes[:, :, None], 1)
                hexes = np.ascontiguousarray(codes.T.astype(np.uint8)).tobytes().hex()
                texts = [hexes[i : i + 2 * positions] for i in range(0, len(hexes), 2 * positions)]
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), pa.array(texts, pa.string()), pa.array((off * off).sum((0, 2)))], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id bigint, label {label}, code string, error bigint")


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dims: int = 64
) -> tuple[DataFrame, np.ndarray]:
    """(rows, books): (id, label, code, error) for every kept vector, and the codebooks (positions, entries, width).

    A round that changes no entry ends the rounds, as all further ones would
    change nothing either. At most 256 entries, as a code has two hex digits.

    Defined cases: vectors that are null, of another length or hold a null or
    non-finite component are left out; fewer kept vectors than entries start as
    many entries; rows without an id are coded, but start an entry only where too
    few others do; repeated rows and ids count and are returned each; an empty
    table gives no rows and empty codebooks; other columns are not looked at,
    whatever their names; components whose distances do not fit a long stop the job.
    """
    kept = integer_vectors(vectors, id_col, vec_col, scale, dims, {"label": label_col})
    blocks = stage(_blocks(kept, positions), "vector-blocks", rebalance=False)
    books = first_books(kept, positions, entries)
    for _ in range(rounds if books.size else 0):
        before, books = books, moved(blocks, books)
        if np.array_equal(before, books):
            break
    rows = stage(_coded(blocks, books), "vector-codes", rebalance=False)
    drop_stage(blocks)
    return rows, books


def books_sha256(books: np.ndarray) -> str:
    """Of all entries' integers by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Eight parts with sixteen entries each after six rounds; the cases are defined as in ``compressed``."""
    rows, books = compressed(read_table(spark, f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    # One row per label, staged, so that a label with many rows can be split, or the sums be sent to all if they are small.
    sums = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-label-errors")
    joined = rows.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    return f"""
a{n} AS MATERIALIZED (SELECT uid, p, min(struct_pack(d := list_sum(list_transform(range(1, 9), lambda i: (q.v[i] - b.v[i]) * (q.v[i] - b.v[i])))::BIGINT, e := b.e)) AS near FROM parts q JOIN b{n} b USING (p) GROUP BY uid, p),
u{n} AS MATERIALIZED (SELECT p, a.near.e AS e, i, sum(q.v[i]) AS s, count(*) AS n FROM a{n} a JOIN parts q USING (uid, p), range(1, 9) r(i) GROUP BY ALL),
m{n} AS MATERIALIZED (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM u{n} GROUP BY p, e),
b{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m USING (p, e)),"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT uid, p, v[8 * p + 1 : 8 * p + 8] AS v FROM kept, range(8) r(p)),
firsts AS (SELECT uid, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS e FROM kept ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT p, e, v FROM firsts JOIN parts USING (uid)),
{"".join(_round_sql(n) for n in range(6))}
last AS MATERIALIZED (SELECT uid, p, min(struct_pack(d := list_sum(list_transform(range(1, 9), lambda i: (q.v[i] - b.v[i]) * (q.v[i] - b.v[i])))::BIGINT, e := b.e)) AS near FROM parts q JOIN b6 b USING (p) GROUP BY uid, p),
coded AS (SELECT uid, string_agg(printf('%02x', near.e), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error FROM last GROUP BY uid),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (uid), books
"""
