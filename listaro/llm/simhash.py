"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is 64 bits. To find all pairs that differ in at most k bits it is
cut into floor(k/2)+1 segments: one of them differs in at most one bit. Each
fingerprint is indexed under every variant of a segment with one bit wild, so
that such a pair meets under an equal key; the pair is then verified on all 64
bits. A pair is taken only under the first key that it shares, so none is made
twice. Work grows with distinct fingerprints, never with documents: copies
share a fingerprint and are grouped before.

A bucket of more than BUCKET fingerprints is not paired. Its members are keyed
again with k further bits wild: those that share such a key differ in at most k
bits, so all of them link to the smallest one, and no link is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listaro.llm.columns import numbered, restored
from listaro.llm.components import components
from listaro.staging import drop_stage, read_table, shuffle_width, stage

SEED = 42
#: A larger bucket is cheaper to key again than to pair.
BUCKET = 1024
#: Where any way between near fingerprints will do, a larger bucket is joined by a star: its fingerprints agree in all but one bit of 32, which hardly happens by chance.
STAR = 32
#: What near copies are, and the fingerprints that look for them: of 48 pairs in sf0.1 four tables find 98 %, three 92 %, one 56 %.
SHINGLE, SIMILARITY, TABLES = 5, 0.8, 4
#: Keys of a shingle set, each of so many least shingles: two sets of similarity 0.8 share none with a chance of 1 in 100,000.
BANDS, BAND_ROWS = 16, 3
_MIXERS = np.random.default_rng(7).integers(1 << 62, size=BANDS * BAND_ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Times that documents of a key are compared with its first one, each time with one more band key in it, before all that is not connected is compared.
DIVISIONS = 3
#: Bytes of sets that are compared with one other in a task, but for a single larger set.
GROUP_BYTES = 1 << 23
#: Ids that are sent to all executors at most, to spare a shuffle of the texts.
SENT_IDS = 1_000_000
#: Words of a text that are in memory at once.
WORDS_AT_ONCE = 200_000


def _word_runs(data: bytes, shingle: int) -> Iterator[list[bytes]]:
    """Runs of words that overlap by shingle - 1 words, so that no shingle is lost between them."""
    kept: list[bytes] = []
    while True:
        words = data.split(None, WORDS_AT_ONCE)
        data = words.pop() if len(words) > WORDS_AT_ONCE else b""
        yield kept + words
        if not data:
            return
        kept = (kept + words)[-(shingle - 1) :] if shingle > 1 else []


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased word shingles, repeats included."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    ones, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    first = True
    for words in _word_runs(data, shingle):
        if first and len(words) <= shingle:
            spans = [b" ".join(words)] if words else []
        elif len(words) < shingle:
            spans = []
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-1]))
            spans = [joined[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())]
        first = False
        if spans:
            hashes = np.array([digest(s, SEED) for s in spans], dtype="<u8")
            ones += np.add.reduce(np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.int64)
            total += len(spans)
    return int(np.packbits(ones * 2 > total).view("<i8")[0]) if total else 0


def word_fingerprints(text: str | None, tables: int) -> list[int] | None:
    """Signed 64-bit SimHashes of the lower-cased words, one per table; None for a text without words.

    A word weighs as the root of its count. An edited word changes one or two
    features, but five of the five-word shingles, so texts whose five-word
    similarity is 0.8 are within few bits; and no table leans on a few frequent words.
    """
    counts: Counter[bytes] = Counter()
    for words in _word_runs((text or "").encode("utf-8", "surrogatepass").lower(), 1):
        counts.update(words)
    if not counts:
        return None
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in counts], dtype="<u8")
    weights = np.round(np.sqrt(np.fromiter(counts.values(), np.float64, len(counts))) * 64).astype(np.int64)
    out = []
    for table in range(tables):
        mixed = hashes * np.uint64(2 * table + 1) if table else hashes
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        ones = weights @ np.unpackbits(mixed.astype("<u8").view(np.uint8)).reshape(-1, 64)
        out.append(int(np.packbits(ones * 2 > weights.sum()).view("<i8")[0]))
    return out


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct lower-cased word shingles."""
    found, first = [], True
    for words in _word_runs((text or "").encode("utf-8", "surrogatepass").lower(), shingle):
        spans = [b" ".join(words[i : i + shingle]) for i in range(max(1 if first and words else 0, len(words) - shingle + 1))]
        found.append(np.array([xxhash.xxh64_intdigest(s, SEED) for s in spans], np.uint64))
        first = False
    return np.unique(np.concatenate(found))


def with_fingerprints(docs: DataFrame, text_col: str = "text", prints: dict | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, and fingerprints as longs; prints: name to function of a text."""
    prints = prints or {"fp": fingerprint}
    others = [f for f in docs.schema.fields if f.name != text_col and f.name not in prints]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"`{n}` bigint" for n in prints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(len(others))]
            found = [pa.array([make(t) for t in texts], pa.int64()) for make in prints.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*(f.name for f in others), *prints])

    return docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def _segments(k: int) -> list[tuple[int, int, int]]:
    """(shift, width, variants) of each segment that a pair within k bits may need.

    Segment s is needed only if all before it differ in two bits or more; at
    most k - 2s bits are left then, and with none left no bit need be wild.
    """
    n = max(2, k // 2 + 1)
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w, w if k - 2 * i else 1) for i, w in enumerate(widths) if k >= 2 * i]


def _variants(k: int):
    """array<struct<slot, rest>>: the segment variants of column fp; rest is the segment with the slot's bit cleared."""
    made, slot = [], 0
    for shift, width, variants in _segments(k):
        part = f"(shiftrightunsigned(fp, {shift}) & {(1 << width) - 1}L)"
        for i in range(variants):
            made.append(f"({slot}L << 40) | ({part} & {((1 << width) - 1) & ~(1 << i)}L)")
            slot += 1
    return F.expr(f"array({', '.join(made)})")


def _first_slot(k: int):
    """The first slot at which fingerprints that differ by column ``x`` share a key."""
    slot, cases = 0, []
    for shift, width, variants in _segments(k):
        part = f"(shiftrightunsigned(x, {shift}) & {(1 << width) - 1}L)"
        cases.append(f"WHEN {part} = 0 THEN {slot}")
        if variants > 1:
            cases.append(f"WHEN bit_count({part}) = 1 THEN {slot} + bit_count({part} - 1)")
        slot += variants
    return F.expr(f"CASE {' '.join(cases)} END")


def _rekeyed(big: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(edges, leads): edges inside large buckets: all fingerprints of a bucket that agree but for k chosen bits; and the staged table they read."""
    free, slot = [], 0
    for shift, width, variants in _segments(k):
        # The wild bit and the bits of the other segments are free; which k of them may differ is chosen here.
        outside = [b for b in range(64) if not shift <= b < shift + width]
        for i in range(variants):
            free.append((slot, [shift + i, *outside]))
            slot += 1
    # At most 64 rows, whatever the data.
    bits = big.sparkSession.createDataFrame(free, "slot int, bits array<int>")
    rows = big.join(F.broadcast(bits), "slot").withColumns({"mask": F.lit(0).cast("long"), "at": F.lit(-1)})
    for _ in range(k):
        rows = rows.filter(F.col("at") + 1 < F.size("bits")).withColumn("next", F.explode(F.sequence(F.col("at") + 1, F.size("bits") - 1)))
        rows = rows.withColumn("mask", F.expr("mask | shiftleft(1L, bits[next])")).withColumn("at", F.col("next")).drop("next")
    rows = rows.select("key", "fp", "mask", F.expr("fp & ~mask").alias("rest"))
    leads = stage(rows.groupBy("key", "mask", "rest").agg(F.min("fp").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n"), "simhash-leads")
    return rows.join(leads, ["key", "mask", "rest"]).filter("fp != lead").select(F.col("lead").alias("u"), F.col("fp").alias("v")), leads


def links(fps: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """The edges of ``links_and_tables``, exact."""
    return links_and_tables(fps, max_bits, bucket)[0]


def links_and_tables(fps: DataFrame, max_bits: int, bucket: int = BUCKET, exact: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """(edges, held): edges (u, v) that connect just the fingerprints (distinct longs in column fp) within max_bits bits, and the staged tables they read.

    Every linked pair is connected by the edges; inside a bucket of more than
    ``bucket`` fingerprints it may be by way of a third that is within max_bits of both.
    Not ``exact``, all fingerprints of a bucket of more than STAR are connected, also those
    further apart, so a group of near fingerprints makes no more edges than it has members.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits is from 0 to 3")
    bucket = bucket if exact else min(bucket, STAR)
    # A small table is one task's, but its keys are many times more.
    index = fps.repartition(shuffle_width(fps.sparkSession)).select("fp", F.explode(_variants(max_bits)).alias("key"))
    full = stage(index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys", rebalance=False)
    met = stage(index.join(full, "key").withColumn("slot", F.expr("shiftright(key, 40)").cast("int")), "simhash-met")
    small = met.filter(F.col("n") <= bucket).select("key", "slot", "fp")
    other = small.select("key", F.col("fp").alias("gp"))
    pair = small.join(other, (small["key"] == other["key"]) & (F.col("fp") < F.col("gp")) & (F.expr("bit_count(fp ^ gp)") <= max_bits))
    edges = pair.select(F.col("fp").alias("u"), F.col("gp").alias("v"), F.expr("fp ^ gp").alias("x"), "slot").filter(F.col("slot") == _first_slot(max_bits))
    edges = edges.select("u", "v")
    big, held = met.filter(F.col("n") > bucket), [full, met]
    if not big.isEmpty():
        # Pairs that also share a small bucket may have been left to a large one that comes first, and are found there.
        if exact:
            more, leads = _rekeyed(big, max_bits)
        else:
            leads = stage(big.groupBy("key").agg(F.min("fp").alias("lead")), "simhash-leads", rebalance=False)
            more = big.join(leads, "key").filter("fp != lead").select(F.col("lead").alias("u"), F.col("fp").alias("v"))
        edges = edges.unionByName(more)
        held.append(leads)
    return edges, held


def _component_ids(rows: DataFrame, fp: str, id_col: str, max_bits: int) -> DataFrame:
    """(fp, component_id): the smallest id reachable from each fingerprint."""
    fps = stage(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("first_id")), "simhash-fps")
    edges, held = links_and_tables(fps, max_bits)
    member = components(edges)
    for table in held:
        drop_stage(table)
    rooted = fps.join(member.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "simhash-rooted")
    firsts = stage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-firsts")
    return stage(rooted.join(firsts, "root").select("fp", "component_id"), "simhash-named")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Every row of ``docs`` (without its text) with ``fp`` and ``component_id``, the smallest id reachable by links.

    Defined cases: null and wordless texts have fingerprint 0 and link like any
    other; fewer words than a shingle count as one shingle; an id that is null
    never names a component unless all ids of it are null; repeated rows each
    appear; columns named fp or component_id are replaced; an empty table gives
    an empty result.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("fp", "component_id")])
    rows = stage(with_fingerprints(docs, text_col, {"fp": lambda t: fingerprint(t, shingle)}), "simhash-rows")
    return rows.join(_component_ids(rows, "fp", id_col, max_bits), "fp")


def _bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of the BAND_ROWS least mixed shingles of a set: sets of similarity s share a key with a chance of s^BAND_ROWS."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * _MIXERS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys + np.arange(BANDS, dtype=np.uint64)


def _prints(texts: DataFrame, tables: int, shingle: int) -> DataFrame:
    """(id, fps, whole, bands) of the texts with words: word fingerprints, a digest of the set of shingles, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py()
                fps = word_fingerprints(text, tables)
                if fps is not None:
                    hashes = shingle_hashes(text, shingle)
                    for column, value in zip(out, (i, fps, xxhash.xxh3_128_digest(hashes.tobytes()), _bands(hashes).view(np.int64).tolist())):
                        column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "fps", "whole", "bands"])

    return texts.mapInArrow(run, "id bigint, fps array<bigint>, whole binary, bands array<bigint>")


def candidate_keys(rows: DataFrame, max_bits: int) -> DataFrame:
    """Staged (key, band, id): documents that share a key may be near copies; band is the place of its band key. ``rows``: (id, fps, bands).

    Fingerprints within max_bits bits lead from one to the other, and form a
    cluster. A cluster is divided by the band keys of its documents' shingle
    sets, so what is compared does not hang on one document that all must resemble.
    """
    each = rows.select("id", F.explode("fps").alias("fp"))
    fps = stage(each.select("fp").distinct(), "simhash-fps", rebalance=False)
    edges, held = links_and_tables(fps, max_bits, exact=False)
    member = stage(components(edges).withColumnsRenamed({"node": "fp"}), "simhash-members")
    of = stage(each.join(member, "fp", "left").select("id", F.coalesce("root", "fp").alias("root")).distinct(), "simhash-clusters", rebalance=False)
    shared = stage(of.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root"), "simhash-shared", rebalance=False)
    near = of.join(shared, "root").join(rows.select("id", "bands"), "id")
    keys = stage(near.select(F.posexplode("bands").alias("band", "value"), "root", "id").select(F.xxhash64("root", "value").alias("key"), "band", "id").distinct(), "simhash-keyed", rebalance=False)
    several = stage(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "simhash-several", rebalance=False)
    out = stage(keys.join(several, "key"), "simhash-keys")
    for table in (fps, member, of, shared, keys, several, *held):
        drop_stage(table)
    return out


def _star_pairs(keys: DataFrame, both_ends: bool) -> tuple[DataFrame, DataFrame]:
    """(pairs (key, band, u, v), leads): in each key the smallest id with every other one, and with ``both_ends`` the largest one too; leads is staged."""
    leads = stage(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high"), "simhash-leads", rebalance=False)
    met = keys.join(leads, "key")
    pairs = met.filter("id != low").select("key", "band", F.col("low").alias("u"), F.col("id").alias("v"))
    more = met.filter("id != high and id != low").select("key", "band", F.col("id").alias("u"), F.col("high").alias("v"))
    return pairs.unionByName(more) if both_ends else pairs, leads


def shingle_sets(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Staged (id, size, hashes): the sets of word shingles of the documents ``ids``, as sorted 32-bit hashes, and their bytes. ``texts``: (id, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique((shingle_hashes(x.as_py(), shingle) >> np.uint64(32)).astype("<u4")).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array(found, pa.binary())], ["id", "size", "hashes"])

    # Few enough ids (16 bytes each, so 16 MB) go to the texts; more meet them in a shuffle.
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    chosen = texts.join(ids, "id")
    # Texts are shuffled for it only where an id repeats.
    repeated = texts.groupBy("id").count().filter("count > 1")
    chosen = chosen if repeated.isEmpty() else chosen.dropDuplicates(["id"])
    return stage(chosen.select("id", "text").mapInArrow(hashed, "id bigint, size bigint, hashes binary"), "simhash-sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Staged (u, v): the pairs whose sets have a Jaccard similarity of ``least`` or more.

    A document's set travels once for each pair in which it is compared with a
    lead, the end that has more pairs; a lead's once for each GROUP_BYTES of those.
    """
    ends = pairs.select("u", "v", "u").toDF("u", "v", "lead").unionByName(pairs.select("u", "v", "v").toDF("u", "v", "lead"))
    many = stage(ends.groupBy("lead").agg(F.count("*").alias("n")), "simhash-ends", rebalance=False)
    counted = pairs.join(many.toDF("u", "of_u"), "u").join(many.toDF("v", "of_v"), "v")
    first = F.col("of_u") >= F.col("of_v")
    pairs = counted.select("u", "v", F.when(first, F.col("u")).otherwise(F.col("v")).alias("lead"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("id"))
    sized = stage(pairs.join(sets.select("id", "size"), "id"), "simhash-sized")
    groups = stage(sized.groupBy("lead").agg(F.ceil(F.sum("size") / GROUP_BYTES).alias("groups")), "simhash-groups", rebalance=False)
    dealt = sized.join(groups, "lead").withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups"))).select("lead", "part", "u", "v", "id")
    dealt = stage(dealt, "simhash-dealt")
    leads = dealt.select("lead", "part").distinct().withColumn("id", F.col("lead")).withColumns({"u": F.lit(None).cast("long"), "v": F.lit(None).cast("long")})

    def compared(table: pa.Table) -> pa.Table:
        us, vs, found = (table.column(c).to_pylist() for c in ("u", "v", "hashes"))
        lead = np.frombuffer(found[us.index(None)], "<u4")
        keep: list[tuple[int, int]] = []
        for u, v, other in zip(us, vs, found):
            if u is not None:
                other = np.frombuffer(other, "<u4")
                both = len(np.intersect1d(lead, other, assume_unique=True))
                if both >= least * (len(lead) + len(other) - both):
                    keep.append((u, v))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*keep) if keep else ((), ()))], names=["u", "v"])

    rows = dealt.unionByName(leads.select(*dealt.columns)).join(sets.select("id", "hashes"), "id")
    out = stage(rows.select("lead", "part", "u", "v", "hashes").groupBy("lead", "part").applyInArrow(compared, "u bigint, v bigint"), "simhash-edges", rebalance=False)
    for table in (many, sized, groups, dealt):
        drop_stage(table)
    return out


def _rarest_hashes(chosen: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Staged (hash, id, root, size, place, indexed): the hashes by which each set meets the sets of other roots that may be like it. ``chosen``: (id, root).

    All hashes are in one order, the rarest first, and ``place`` counts them from 1. Of two similar sets the larger has the first
    hash that both have among its first size - least * size + 1, and the smaller one among fewer, the ``indexed``.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, root, size, found in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                hashes = np.frombuffer(found.as_py(), "<u4").astype(np.int64)
                for at in range(0, size, 1 << 16):
                    part = hashes[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.full(len(part), x)) for x in (i, root, size))], ["hash", "id", "root", "size"])

    rows = chosen.join(sets, "id").select("id", "root", (F.col("size") / 4).cast("long").alias("size"), "hashes").mapInArrow(listed, "hash bigint, id bigint, root bigint, size bigint")
    rows = stage(rows, "simhash-hashes")
    several = stage(rows.groupBy("hash").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("joins")).filter("n > 1"), "simhash-several", rebalance=False)
    # Hashes that one set alone has are the rarest of all: they are only counted.
    each = rows.join(several, "hash").groupBy("id", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "hash", "joins"))).alias("shared"))
    each = each.select("id", "root", "size", (F.col("size") - F.size("shared")).alias("alone"), "shared")

    def first(part: float) -> Column:
        return F.col("size") - F.ceil(F.col("size") * part - 1e-9) + 1

    needed = F.greatest(first(least) - F.col("alone"), F.lit(0)).cast("int")
    placed = each.select("id", "root", "size", "alone", F.posexplode(F.slice("shared", 1, needed)).alias("at", "x")).withColumn("place", F.col("alone") + F.col("at") + 1)
    out = stage(placed.filter("x.joins").select("x.hash", "id", "root", "size", "place", (F.col("place") <= first(2 * least / (1 + least))).alias("indexed")), "simhash-rarest")
    for table in (rows, several):
        drop_stage(table)
    return out


def remaining_pairs(keys: DataFrame, edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Staged (u, v): pairs that no way of ``edges`` connects, all that are similar among them, of the documents under keys that hold such pairs. ``keys``: (key, id).

    Not all pairs under a key are made: two similar sets share one of their rarest hashes, and enough can follow it in both.
    """
    roots = components(edges)
    of = stage(keys.select("key", "id").distinct().join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "simhash-rooted")
    several = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    chosen = stage(of.join(several, "key").select("id", "root").distinct(), "simhash-apart", rebalance=False)
    rarest = _rarest_hashes(chosen, sets, least)
    other = rarest.filter("indexed").select("hash", *[F.col(c).alias(f"{c}2") for c in ("id", "root", "size", "place")])
    larger = (F.col("size") > F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("id") > F.col("id2")))
    # What both can have from the first common hash on.
    most = 1 + F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))
    enough = most * (1 + least) + 1e-9 >= (F.col("size") + F.col("size2")) * least
    met = rarest.join(other, "hash").filter((F.col("root") != F.col("root2")) & larger & enough)
    out = stage(met.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct(), "simhash-remaining", rebalance=False)
    for table in (of, chosen, rarest):
        drop_stage(table)
    return out


def near_copy_edges(texts: DataFrame, max_bits: int, tables: int, shingle: int, least: float) -> DataFrame:
    """(u, v): verified pairs of near copies, u < v, that connect them; ``texts``: (id, text).

    Documents with the same set of shingles are told by its digest, and the first
    stands for all. In each key the first document is compared with all others,
    and the last one too. Those that are not like the first are divided by a further
    band key and compared again, in all DIVISIONS times: so what is alike still
    shares a key with a good chance, and what is not hardly does.
    """
    rows = stage(_prints(texts, tables, shingle), "simhash-rows", rebalance=False)
    alike = stage(rows.groupBy("whole").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("whole", "lead"), "simhash-alike", rebalance=False)
    edges = stage(rows.join(alike, "whole").filter("id != lead").select(F.col("lead").alias("u"), F.col("id").alias("v")), "simhash-edges")
    firsts = stage(rows.join(edges.select(F.col("v").alias("id")).distinct(), "id", "left_anti").select("id", "fps", "bands"), "simhash-firsts")
    keys = first_keys = candidate_keys(firsts, max_bits)
    bands = stage(firsts.join(keys.select("id").distinct(), "id").select("id", "bands"), "simhash-bands")
    sets = shingle_sets(texts, bands.select("id").distinct(), shingle)
    held, done = [rows, alike, firsts, bands, sets], None
    for division in range(DIVISIONS):
        found, leads = _star_pairs(keys, division == 0)
        met = stage(found, "simhash-pairs")
        fresh = met.select("u", "v").distinct()
        fresh = stage(fresh if done is None else fresh.join(done, ["u", "v"], "left_anti"), "simhash-fresh")
        edges = edges.unionByName(similar_pairs(fresh, sets, least))
        done = fresh if done is None else done.unionByName(fresh)
        # Who is not like the first of its key goes on.
        unlike = met.join(leads.select("key", F.col("low").alias("u")), ["key", "u"], "left_semi").join(edges, ["u", "v"], "left_anti")
        further = F.element_at("bands", (F.col("band") + division + 1) % BANDS + 1)
        rest = stage(unlike.select("key", "band", F.col("v").alias("id")).join(bands, "id").select(F.xxhash64("key", further).alias("key"), "band", "id").distinct(), "simhash-keys", rebalance=False)
        for table in (leads, met, *([keys] if division else [])):
            drop_stage(table)
        keys = rest
        held.append(fresh)
        if keys.isEmpty():
            break
    edges = stage(edges, "simhash-edges")
    left = remaining_pairs(first_keys, edges, sets, least)
    edges = edges.unionByName(similar_pairs(left.join(done, ["u", "v"], "left_anti"), sets, least))
    for table in (keys, first_keys, left, *held):
        drop_stage(table)
    return edges


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, tables: int = TABLES, shingle: int = SHINGLE, least: float = SIMILARITY
) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id; same columns.

    Documents whose sets of word shingles have a Jaccard similarity of ``least``
    or more are near copies, and so are those that such pairs lead from one to
    the other. See ``candidate_keys`` for which are compared.

    Defined cases: wordless and null texts are left alone; fewer words than a
    shingle count as one shingle; ids are longs and unique, rows without one
    stay; rows that repeat an id stay or go together, the text of one of them
    standing for all; columns of any name pass through; an empty table gives an
    empty result; a very long text is read in runs of words.
    """
    docs, new = numbered(docs)
    texts = docs.filter(F.col(new[id_col]).isNotNull()).select(F.col(new[id_col]).cast("long").alias("id"), F.col(new[text_col]).cast("string").alias("text"))
    lost = components(near_copy_edges(texts, max_bits, tables, shingle, least)).filter("node != root").select("node")
    return restored(docs.join(lost, F.col(new[id_col]) == F.col("node"), "left_anti"), new)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; the cases are defined as in ``near_groups``."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
