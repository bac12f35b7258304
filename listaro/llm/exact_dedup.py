"""Exact dedup by deterministic block naming.

The normalised UTF-8 bytes of a document are cut into fixed-size blocks. The
distinct blocks are sorted inside name buckets and get integer names; then
adjacent pairs of names are named again, level by level, until each document
has a single name. Two documents get the same (level, name) exactly if their
bytes are equal: no step trusts a hash. Hashes only deal out work and carry a
block's name back to its documents, and where two different blocks share a hash
the name is carried back by the block itself.

Cost at scale: the text is shuffled for the block sort and never again; all
later levels move a few longs per block. A block or pair that a third of the
rows share is reduced to one row per map task before the shuffle, and names are
joined back from staged tables, so that adaptive execution can split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listaro.llm.columns import numbered, restored
from listaro.staging import read_table, shuffle_width, stage

BLOCK_BYTES = 2048
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str | F.Column):
    """Null as empty; each run of ASCII white space as one space."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), SPACES, " ")


def _blocks(norm):
    """The blocks of a binary column as array<binary>; one empty block for an empty text."""
    size = F.octet_length(norm)
    last = F.greatest(F.ceil(size / BLOCK_BYTES) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(norm, i * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)))


def _named(distinct: DataFrame, bucket, order: list[str], buckets: int) -> DataFrame:
    """Name distinct rows: their place in the sorted bucket, times the buckets, plus the bucket."""
    place = Window.partitionBy("bucket").orderBy(*order)
    return (
        distinct.withColumn("bucket", F.pmod(bucket, F.lit(buckets)))
        .withColumn("name", (F.row_number().over(place) - 1).cast("long") * buckets + F.col("bucket"))
    )


def document_names(docs: DataFrame, text_col: str = "text", hash_col=F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(rows, names): every input row with ``uid``, and per uid its identity (level, name).

    ``rows`` has uid, ``text_sha256`` and the columns of ``docs`` but the text.
    ``hash_col`` maps a binary column to a long; tests give a poor one.
    """
    spark = docs.sparkSession
    buckets = max(4096, 16 * shuffle_width(spark))
    norm = normalised(text_col).cast("binary")
    kept_cols = [F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(docs.columns) if c != text_col]
    names_of = {f"k_{i}": c for i, c in enumerate(docs.columns) if c != text_col}
    cut = docs.select(*kept_cols, F.col(f"`{text_col}`").alias("norm")).withColumn("norm", normalised("norm").cast("binary"))
    rows = stage(
        cut.select(
            F.monotonically_increasing_id().alias("uid"),
            *names_of,
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("norm")), lambda b: hash_col(b)).alias("hashes"),
        ),
        "exact-rows",
    )

    # Level 0: distinct blocks, sorted inside their bucket. The hash leads the sort only to make it fast.
    blocks = docs.select(normalised(text_col).cast("binary").alias("norm")).select(F.explode(_blocks(F.col("norm"))).alias("block"))
    distinct = blocks.select("block", hash_col(F.col("block")).alias("h")).distinct()
    beside = Window.partitionBy("bucket").orderBy("h", "block")
    named = _named(distinct, F.col("h"), ["h", "block"], buckets).withColumn(
        "shared", (F.col("h") == F.lag("h").over(beside)) | (F.col("h") == F.lead("h").over(beside))
    )
    level0 = stage(
        named.select("h", "name", F.coalesce("shared", F.lit(False)).alias("shared"), F.when(F.col("shared"), F.col("block")).alias("block")),
        "exact-blocks",
    )
    places = rows.select("uid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    current = places.join(level0.filter(~F.col("shared")).select("h", "name"), "h").select("uid", "n", "pos", "name")
    clashing = level0.filter("shared").select("h", "block", "name")
    if not clashing.isEmpty():
        current = current.unionByName(_by_block(docs, text_col, rows, clashing, hash_col))
    current = stage(current, "exact-level")

    done = []
    level = 0
    longest = rows.agg(F.max(F.size("hashes"))).first()[0] or 1
    while True:
        done.append(current.filter("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        longest, level = (longest + 1) // 2, level + 1
        pairs = (
            current.filter("n > 1")
            .groupBy("uid", "n", (F.col("pos") / 2).cast("int").alias("place"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        pairs = stage(pairs, "exact-pairs")
        ordered = stage(_named(pairs.select("left", "right").distinct(), F.xxhash64("left", "right"), ["left", "right"], buckets).drop("bucket"), "exact-names")
        current = stage(
            pairs.join(ordered, ["left", "right"]).select("uid", ((F.col("n") + 1) / 2).cast("int").alias("n"), F.col("place").alias("pos"), "name"),
            "exact-level",
        )
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    rows = rows.drop("hashes").withColumnsRenamed(names_of)
    return rows, names


def _by_block(docs, text_col, rows, clashing, hash_col) -> DataFrame:
    """The same as the join on the hash, for blocks whose hash another block has too."""
    suspects = rows.select("uid", "text_sha256", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    suspects = suspects.join(clashing.select("h").distinct(), "h", "left_semi")
    texts = docs.select(normalised(text_col).cast("binary").alias("norm"))
    # Another scan may number its rows otherwise, so a row finds its text again by SHA-256.
    texts = texts.select(F.sha2("norm", 256).alias("text_sha256"), "norm").dropDuplicates(["text_sha256", "norm"])
    cut = texts.select("text_sha256", F.posexplode(_blocks(F.col("norm"))).alias("pos", "block"))
    return (
        suspects.join(cut, ["text_sha256", "pos"])
        .join(clashing, ["h", "block"])
        .select("uid", "n", "pos", "name")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row with its group of equal texts.

    Returns one row per input row: the columns of ``docs`` but the text, and
    ``keep_id`` (smallest id of the group), ``group_size``, ``kept`` and
    ``text_sha256``. Columns of ``docs`` with those names are replaced.

    Defined cases: a null text equals the empty text; white-space runs equal one
    space, also at the ends; of rows with equal text *and* equal id only one is
    kept; a null id sorts after every other id; an empty table gives an empty
    result; very long texts only have more blocks.
    """
    docs, new = numbered(docs, ("keep_id", "group_size", "kept", "text_sha256"))
    rows, names = document_names(docs, new[text_col])
    keyed = stage(rows.join(names, "uid"), "exact-keyed")
    first = F.min(F.struct(F.col(new[id_col]).isNull().alias("no_id"), F.col(new[id_col]).alias("id"), "uid"))
    groups = stage(keyed.groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("group_size")), "exact-groups")
    return restored(
        keyed.join(groups, ["level", "name"]),
        {c: n for c, n in new.items() if c != text_col},
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another kept row has; same columns, see exact_groups.

    The texts are shuffled once, by id, to meet the decisions; repeated rows fall to one.
    The cases are those of exact_groups; columns of any name pass through.
    """
    docs, new = numbered(docs)
    id_col, text_col = new[id_col], new[text_col]
    keys = ["no_id", "id", "sha"]
    kept = exact_groups(docs.select(id_col, text_col), id_col, text_col).filter("kept")
    kept = kept.select(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    rows = docs.withColumns({"no_id": F.col(id_col).isNull(), "id": F.col(id_col), "sha": F.sha2(normalised(text_col), 256)})
    plain = rows.filter("not no_id").join(kept.filter("not no_id"), keys, "left_semi")
    no_id = rows.filter("no_id").join(kept.filter("no_id").select("sha"), "sha", "left_semi")
    return restored(plain.select(*rows.columns).unionByName(no_id.select(*rows.columns)).dropDuplicates(keys), new)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts; the cases are defined as in ``exact_groups``."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
