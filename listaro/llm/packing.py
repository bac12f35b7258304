"""Packing into optimal length buckets.

Dynamic programming over the global histogram of lengths picks the bucket
boundaries with the least padding. The histogram has a row per distinct length,
so it is bounded by the longest text and not by the number of documents; the
cost is Monge, so each round of the programme is solved by halving, in time
near-linear in the distinct lengths. Inside a bucket, documents of like length
form batches whose padded size keeps to a token budget.

A bucket may hold a third of all documents, so it is dealt into chunks of a
bounded number of documents, and batches form inside chunks, each in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listaro.staging import read_table, stage

BUCKETS = 16
BATCH_TOKENS = 65_536
CHUNK_DOCS = 4096
CHUNK_BATCHES = 16


def word_count(text_col: str):
    """Words between ASCII white space; null has none."""
    return F.expr(f"coalesce(regexp_count(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0)").cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` boundaries (of the given, rising lengths) with the least total padding; of equal ones the fewest, then the lowest."""
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    size = np.array(lengths, dtype=object if sum(counts) * lengths[-1] > 2**62 else np.int64)
    before = np.concatenate(([0], np.cumsum(np.array(counts, dtype=size.dtype))))
    # cost[j]: least padded size of the first j + 1 lengths; each round allows one bucket more.
    cost = before[1:] * size
    came_from = []
    for _ in range(buckets - 1):
        best, source = cost.copy(), np.full(n, -1)
        # The first boundary before j rises with j, so the middle j tells where those of either half can lie.
        halves = [(1, n - 1, 0, n - 2)]
        while halves:
            low, high, first, last = halves.pop()
            if low > high:
                continue
            j = (low + high) // 2
            upto = min(j - 1, last)
            tried = cost[first : upto + 1] + (before[j + 1] - before[first + 1 : upto + 2]) * size[j]
            i = first + int(np.argmin(tried))
            if tried[i - first] < best[j]:
                best[j], source[j] = tried[i - first], i
            halves += [(low, j - 1, first, i), (j + 1, high, i, last)]
        cost = best
        came_from.append(source)
    cuts, j = [lengths[-1]], n - 1
    for source in reversed(came_from):
        if source[j] >= 0:
            j = int(source[j])
            cuts.append(lengths[j])
    return cuts[::-1]


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BATCH_TOKENS) -> DataFrame:
    """Each document with its place: n_tokens, bucket (the padded length), chunk, batch and padding.

    A batch is named by (bucket, chunk, batch) and holds budget // bucket
    documents, the last of a chunk perhaps fewer. A document longer than the
    budget is a batch of its own.

    Defined cases: null and blank texts have length 0 and go to the lowest
    bucket, as long as 1; rows without an id are dealt into chunks by their
    texts; repeated rows are each placed; other columns are not looked at; an empty table gives an empty result; a very long text is counted whole.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(text_col).alias("n_tokens"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))).alias("key"))
    rows = stage(rows.withColumn("size", F.greatest("n_tokens", F.lit(1))), "packing-lengths")
    # One row per distinct length: bounded by the longest text.
    histogram = sorted(map(tuple, rows.groupBy("size").count().collect()))
    lengths, counts = [s for s, _ in histogram], [c for _, c in histogram]
    cuts = best_boundaries(lengths, counts, buckets)
    deal = []
    for low, cut in zip([0, *cuts], cuts):
        per = max(1, budget // cut)
        held = sum(c for s, c in histogram if low < s <= cut)
        deal.append((cut, per, -(-held // max(CHUNK_DOCS, CHUNK_BATCHES * per))))
    if not deal:
        deal = [(1, 1, 1)]

    def case(at: int) -> str:
        return "CASE " + " ".join(f"WHEN size <= {d[0]} THEN {d[at]}L" for d in deal) + " END"

    rows = rows.select("doc_id", "n_tokens", "key", F.expr(case(0)).alias("bucket"), F.expr(case(1)).alias("per"), F.expr(case(2)).alias("chunks"))
    mixed = F.expr("pmod(key, 1073741824L) * 2654435761L % 4294967296L div 65536L % chunks")
    place = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("n_tokens", "doc_id")) - 1
    return rows.withColumn("chunk", mixed).select(
        F.col("doc_id").alias(id_col), "n_tokens", "bucket", "chunk", F.floor(place / F.col("per")).cast("long").alias("batch"), (F.col("bucket") - F.col("n_tokens")).alias("padding")
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's place; the cases are defined as in ``packed``."""
    return packed(read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same in DuckDB; the recursion adds a bucket a round to the best way to cover each prefix of the histogram.
OP3_SQL = rf"""
WITH RECURSIVE lens AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), gridded AS (
  SELECT doc_id, n_tokens, greatest(n_tokens, 1) AS grid FROM lens
), hist AS (
  SELECT grid, row_number() OVER (ORDER BY grid) AS j, sum(count(*)) OVER (ORDER BY grid)::BIGINT AS upto
  FROM gridded GROUP BY grid
), dp AS (
  SELECT 1 AS k, j, grid, upto, upto * grid AS cost, [grid] AS cuts FROM hist
  UNION ALL
  SELECT k + 1, j, any_value(grid), any_value(upto), min(cost), arg_min(cuts, (cost, ord, i))
  FROM (
    SELECT k, j, grid, upto, cost, cuts, 0 AS ord, 0 AS i FROM dp WHERE k < {BUCKETS}
    UNION ALL
    SELECT d.k, h.j, h.grid, h.upto, d.cost + (h.upto - d.upto) * h.grid, list_append(d.cuts, h.grid), 1, d.j
    FROM dp d JOIN hist h ON d.j < h.j WHERE d.k < {BUCKETS}
  ) GROUP BY k, j
), best AS (
  SELECT unnest(cuts) AS cut FROM dp WHERE k = {BUCKETS} AND j = (SELECT max(j) FROM hist)
), spans AS (
  SELECT cut, coalesce(lag(cut) OVER (ORDER BY cut), 0) AS low, greatest(1, {BATCH_TOKENS} // cut) AS per FROM best
), held AS (
  SELECT s.cut, s.low, s.per, count(*) AS held FROM spans s JOIN gridded g ON g.grid > s.low AND g.grid <= s.cut GROUP BY ALL
), deal AS (
  SELECT cut, low, per, ceil(held / greatest({CHUNK_DOCS}, {CHUNK_BATCHES} * per)::DOUBLE)::BIGINT AS chunks FROM held
), placed AS (
  SELECT doc_id, n_tokens, cut AS bucket, per,
         (coalesce(doc_id, 0) % 1073741824) * 2654435761 % 4294967296 // 65536 % chunks AS chunk
  FROM gridded JOIN deal ON grid > low AND grid <= cut
)
SELECT doc_id, n_tokens, bucket, chunk,
       (row_number() OVER (PARTITION BY bucket, chunk ORDER BY n_tokens, doc_id) - 1) // per AS batch,
       bucket - n_tokens AS padding
FROM placed
"""
