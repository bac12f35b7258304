"""Suffix-array dedup: remove every byte covered by a long string that starts anywhere else too.

A corpus-wide suffix array does not fit anywhere, so the text that can repeat is
found first. In each window of SPAN bytes the least hash of its GRAM-byte pieces
marks an anchor, so equal windows have equal anchors at the same place. The
windows of an anchor are neighbours; the stretch they cover is its context, and
every window lies in just one context. Contexts of an anchor that occurs once
cannot hold a repeat. Equal contexts (equal anchors and equal 64-bit hashes of
the bytes, 128 bits together) are repeats as they stand. The differing contexts
of the other anchors go, one of each kind, to shards by anchor; each shard is
sorted by induced sorting and its permuted common prefixes tell which strings
recur.

An anchor with more contexts than a shard should hold is split by what
surrounds it: windows that reach about as far to its left share a longer piece,
and only contexts with equal pieces can share such windows. Pieces are split
again until a group fits; a group whose windows have but one place in their
piece is a single string, so the splitting ends, and no link is lost.
Shuffled are 64-bit hashes of anchors, the contexts of the third kind, and the
texts once for those contexts and once for the removal.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.llm.suffix_array import common_prefixes, suffix_array
from listaro.staging import drop_stage, read_table, stage

SPAN = 200
GRAM = 40
#: Bytes of contexts that a shard is planned for.
SHARD_BYTES = 1 << 19
#: Differing contexts of one group beyond which it is split by further context.
GROUP_CONTEXTS = 4000
#: Bytes of a text that are hashed at once.
PIECE = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte piece, by doubling polynomial hashes."""
    powers, hashes, m = {1: _BASE}, {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while 2 * m <= GRAM:
        h = hashes[m]
        hashes[2 * m] = h[: len(h) - m] * np.uint64(powers[m]) + h[m:]
        powers[2 * m] = powers[m] * powers[m] & _WRAP
        m *= 2
    n = len(data) - GRAM + 1
    out, done = hashes[m][:n], m
    while m > 1:
        m //= 2
        if GRAM & m:
            out = out * np.uint64(powers[m]) + hashes[m][done : done + n]
            done += m
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, from, to): each anchor, and the stretch that its windows cover.

    The anchor of a window is its leftmost piece with the least hash.
    """
    found = []
    width = SPAN - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    for begin in range(0, max(1, len(data) - SPAN + 1), PIECE):
        part = np.frombuffer(data, np.uint8, min(len(data) - begin, PIECE + SPAN - 1), begin)
        if len(part) < SPAN:
            break
        grams = _gram_hashes(part)
        # The position in the low bits makes the least unique, and the leftmost of equal ones.
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        w = 1
        while 2 * w <= width:
            least = np.minimum(least[: len(least) - w], least[w:])
            w *= 2
        if width > w:
            least = np.minimum(least[: len(least) - (width - w)], least[width - w :])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        at = (least[first] & low).astype(np.int64)
        found.append((at + begin, grams[at], first + begin, np.append(first[1:], len(least)) - 1 + SPAN + begin))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, np.empty(0, np.uint64), empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def _utf8(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of intervals; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], starts[1:] > ends[:-1]))
    last = np.concatenate((first[1:], [True]))
    return starts[first], ends[last]


_ANCHORS = "h bigint, c bigint, n bigint, uid bigint, `left` int, `from` bigint, `to` bigint"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, n, uid, left, from, to): anchors with the hash of their context; n: how often the text has this context; left: its bytes before the anchor.

    A context that recurs inside its text is a repeat already; those stretches come with h null.
    """
    kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2
    for batch in batches:
        cols: list[list] = [[] for _ in kinds]
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = _utf8(text.as_py())
            if len(data) < SPAN:
                continue
            at, hashes, begin, end = anchors(data)
            left = at - begin
            digest = xxhash.xxh3_64_intdigest
            codes = np.array([digest(data[lo:hi], k) for lo, hi, k in zip(begin.tolist(), end.tolist(), left.tolist())], np.uint64)
            count = np.ones(len(at), np.int64)
            if len(np.unique(codes)) < len(codes):
                _, first, back, counts = np.unique(np.stack([hashes, codes], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
                own = counts[back.ravel()] > 1
                starts, ends = merged(begin[own], end[own]) if own.any() else (begin[:0], end[:0])
                none = [None] * len(starts)
                for col, values in zip(cols, (none, none, [0] * len(starts), [uid] * len(starts), none, starts.tolist(), ends.tolist())):
                    col.extend(values)
                hashes, codes, left, begin, end, count = hashes[first], codes[first], left[first], begin[first], end[first], counts
            for col, values in zip(cols, (hashes.view(np.int64), codes.view(np.int64), count, np.full(len(left), uid), left, begin, end)):
                col.extend(values.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "c", "n", "uid", "left", "from", "to"])


#: A piece of text: group, kind in the group, how often it occurs, where, the bytes before its anchor, and its own.
_PIECES = "g bigint, e bigint, n bigint, uid bigint, `left` int, `from` bigint, bytes binary"
_PIECE_KINDS = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
_PIECE_NAMES = ["g", "e", "n", "uid", "left", "from", "bytes"]


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, wanted [h, c, n, left, from, to]) to one piece per context."""
    for batch in batches:
        rows: list[list] = [[] for _ in _PIECE_KINDS]
        for uid, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = _utf8(text.as_py())
            for w in wanted:
                for col, value in zip(rows, (w["h"], w["c"], w["n"], uid, w["left"], w["from"], data[w["from"] : w["to"]])):
                    col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _PIECE_KINDS)], _PIECE_NAMES)


def split_piece(g: int, left: int, text: bytes, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(group, begin, end, low, high) of the parts of a piece whose windows reach ``low`` to ``high`` bytes left of the anchor.

    The windows of either half all hold a longer stretch around the anchor, which names the part's group.
    """
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        nearest, farthest = max(a, left - (len(text) - SPAN)), min(b, left)
        if a <= b and nearest <= farthest:
            shared = text[left - a : left + SPAN - b]
            group = xxhash.xxh3_64_intdigest(shared, (g * 512 + a + b * 7919) & _WRAP)
            yield group - (1 << 64) if group >> 63 else group, left - farthest, left + SPAN - nearest, a, b


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one round, with their range (low, high), to those of the next."""
    for batch in batches:
        rows: list[list] = [[] for _ in range(9)]
        for g, n, uid, left, start, text, low, high in zip(*[batch.column(i).to_pylist() for i in range(8)]):
            for group, begin, end, a, b in split_piece(g, left, text, low, high):
                own = text[begin:end]
                kind = xxhash.xxh3_64_intdigest(own, left - begin)
                for col, value in zip(rows, (group, kind - (1 << 64) if kind >> 63 else kind, n, uid, left - begin, start + begin, own, a, b)):
                    col.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, [*_PIECE_KINDS, pa.int32(), pa.int32()])], [*_PIECE_NAMES, "low", "high"])


def _worth_sorting(groups: list, lefts: list, texts: list) -> list[int]:
    """Pieces that share SPAN - GRAM bytes around the anchor with another of the same group, as a repeat must.

    A repeat reaches r bytes right of the anchor and at least SPAN - GRAM - r left of it; r is cut down to a multiple of GRAM.
    """
    keys = []
    for g, left, text in zip(groups, lefts, texts):
        own = []
        for r in range(0, SPAN - GRAM, GRAM):
            lo, hi = left - (SPAN - 2 * GRAM - r), left + GRAM + r
            if lo >= 0 and hi <= len(text):
                own.append((g, r, text[lo:hi]))
        keys.append(own)
    shared = Counter(k for own in keys for k in own)
    return [i for i, own in enumerate(keys) if any(shared[k] > 1 for k in own)]


def shard_repeats(groups: list, lefts: list, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(number of the piece, from, to), relative to the piece: stretches made of strings that recur, by a suffix array of the shard."""
    chosen = _worth_sorting(groups, lefts, texts)
    if not chosen:
        return
    # A separator per piece would need many symbols; one is enough, as strings that hold it are left out.
    joined = np.frombuffer(b"".join(texts[i] + b"\xff" for i in chosen), np.uint8)
    sizes = np.array([len(texts[i]) + 1 for i in chosen])
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(chosen), dtype=np.int32), sizes)
    whole = np.arange(len(joined)) - first[owner] + SPAN < sizes[owner]
    sa = suffix_array(joined, 256)
    _, common = common_prefixes(joined, sa, 2 * SPAN, first)
    # Suffixes with SPAN equal bytes are neighbours. Every window lies in one piece of its group, so two are two places.
    group = np.cumsum(common[sa] < SPAN)
    use = whole[sa]
    sa, group = sa[use], group[use]
    if not len(sa):
        return
    alike = group[1:] == group[:-1]
    marked = np.sort(sa[np.concatenate(([False], alike)) | np.concatenate((alike, [False]))]).astype(np.int64)
    if not len(marked):
        return
    for a, b in zip(*(x.tolist() for x in merged(marked, marked + SPAN))):
        i = int(owner[a])
        yield chosen[i], a - int(first[i]), b - int(first[i])


def _sort_shard(table: pa.Table) -> pa.Table:
    """Pieces of a shard to (g, e, uid, from, to): stretches that recur, of pieces that occur once."""
    cols = {k: table[k].to_pylist() for k in _PIECE_NAMES}
    rows = [(cols["g"][i], cols["e"][i], cols["uid"][i], cols["from"][i] + a, cols["from"][i] + b) for i, a, b in shard_repeats(cols["g"], cols["left"], cols["bytes"]) if cols["n"][i] == 1]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["g", "e", "uid", "from", "to"])


def _sorted(pieces: DataFrame, size: int) -> DataFrame:
    """(g, e, uid, from, to) of pieces, one of each kind; ``size``: about how many bytes they have."""
    shards = max(1, size // SHARD_BYTES)
    return pieces.groupBy(F.pmod(F.xxhash64("g"), F.lit(shards))).applyInArrow(_sort_shard, "g bigint, e bigint, uid bigint, `from` bigint, `to` bigint")


def _split_until_small(pieces: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans, held): tables of (uid, from, to) for pieces of groups that are too large to sort as they are, and the staged tables they read."""
    out, held = [], []
    now = pieces.select("g", "n", "uid", "left", "from", "bytes", F.lit(0).alias("low"), F.lit(SPAN - GRAM).alias("high"))
    rounds = (SPAN - GRAM).bit_length()
    for _ in range(rounds):  # a part's range is halved each time, until it is a single window
        parts = stage(now.mapInArrow(_split, f"{_PIECES}, low int, high int"), "substrings-parts")
        kinds = stage(parts.groupBy("g", "e").agg(F.sum("n").alias("times")), "substrings-part-kinds")
        held += [parts, kinds]
        sizes = stage(kinds.groupBy("g").agg(F.count("*").alias("kinds"), F.sum("times").alias("total"), F.min("times").alias("fewest")).filter("total > 1"), "substrings-part-groups")
        # Equal parts are repeats from end to end; a part that occurs once may still share windows with others of its group.
        told = parts.join(kinds, ["g", "e"]).withColumn("to", F.col("from") + F.octet_length("bytes"))
        out.append(told.filter("times > 1 and n = 1").select("uid", "from", "to"))
        open_groups = sizes.filter("kinds > 1 and fewest = 1")
        fit = open_groups.filter(F.col("kinds") <= GROUP_CONTEXTS)
        count = fit.agg(F.sum("kinds")).first()[0]
        if count:
            one = told.join(fit.select("g"), "g").groupBy("g", "e").agg(F.min(F.struct("times", "uid", "left", "from", "bytes")).alias("p"))
            found = _sorted(one.select("g", "e", F.col("p.times").alias("n"), "p.uid", "p.left", "p.from", "p.bytes"), count * SPAN)
            out.append(found.select("uid", "from", "to"))
        large = stage(open_groups.filter(F.col("kinds") > GROUP_CONTEXTS).select("g"), "substrings-part-large")
        if large.isEmpty():
            break
        now = parts.join(large, "g").select("g", "n", "uid", "left", "from", "bytes", "low", "high")
    return out, held


def repeats(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): rows as (uid, text, other columns), and (uid, from, to) stretches of repeats, which may overlap.

    Rows are numbered in a staged copy, so that all passes see the same numbers:
    another scan of the same files may deal and number the rows otherwise.
    """
    others = [c for c in docs.columns if c != text_col]
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(others)])
    texts = stage(texts, "substrings-texts", rebalance=False)
    rows = stage(texts.select("uid", "text").mapInArrow(_anchor_rows, _ANCHORS), "substrings-anchors", rebalance=False)
    inside = rows.filter("h is null").select("uid", "from", "to")
    again = stage(rows.filter("h is not null").groupBy("h").agg(F.sum("n").alias("total")).filter("total > 1").select("h"), "substrings-again")
    shared = stage(rows.join(again, "h"), "substrings-shared")
    drop_stage(again)
    kinds = stage(shared.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("uid", "left", "from", "to")).alias("first")).select("h", "c", "n", "first.*"), "substrings-kinds")
    # Equal contexts are repeats from end to end.
    spans = [inside, shared.join(kinds.filter("n > 1").select("h", "c"), ["h", "c"]).select("uid", "from", "to")]

    per_anchor = kinds.groupBy("h").agg(F.count("*").alias("contexts"), F.min("n").alias("fewest")).filter("contexts > 1 and fewest = 1")
    per_anchor = stage(per_anchor.select("h", "contexts"), "substrings-contested")
    wanted = kinds.join(per_anchor, "h").groupBy("uid").agg(F.collect_list(F.struct("h", "c", "n", "left", "from", "to")).alias("wanted"))
    cut = texts.select("uid", "text").join(wanted, "uid").mapInArrow(_cut_contexts, _PIECES)
    total, most = per_anchor.agg(F.sum(F.when(F.col("contexts") <= GROUP_CONTEXTS, F.col("contexts"))), F.max("contexts")).first()
    held = []
    if (most or 0) > GROUP_CONTEXTS:
        # Such anchors are few: each has more than GROUP_CONTEXTS rows of its own.
        cut = stage(cut, "substrings-contexts", rebalance=False)
        held.append(cut)
        large = per_anchor.filter(F.col("contexts") > GROUP_CONTEXTS).select(F.col("h").alias("g"))
        found, read = _split_until_small(cut.join(large, "g"))
        spans, held = spans + found, held + read
        cut = cut.join(large, "g", "left_anti")
    spans.append(_sorted(cut, (total or 0) * (SPAN + GRAM)).select("uid", "from", "to"))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    out = stage(out, "substrings-spans")
    for table in (rows, shared, kinds, per_anchor, *held):
        drop_stage(table)
    return texts, out


def with_removals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its text stripped of repeats, and n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes).

    A byte goes if any SPAN-byte string over it also starts elsewhere in the
    input, the same text included; strings are judged on the input. The
    stripped text drops a character whose bytes went only in part.

    Defined cases: null is the empty text, texts shorter than SPAN keep all
    their bytes; repeated rows count as so many occurrences; columns of ``docs``
    named as a result are replaced; an empty table gives an empty result; a very
    long text is hashed piece by piece.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    others = [f for f in docs.schema.fields if f.name != text_col]
    texts, spans = repeats(docs, text_col)
    # One list per text, never longer than its anchors.
    per_text = spans.groupBy("uid").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = texts.join(per_text, "uid", "left").select("text", "spans", *[f"c_{i}" for i in range(len(others))])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(0), batch.column(1).to_pylist()):
                data = _utf8(text.as_py())
                kept, runs, lost = data, 0, 0
                if found:
                    starts, ends = merged(np.array([s["from"] for s in found]), np.array([s["to"] for s in found]))
                    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    runs, lost = len(starts), int((ends - starts).sum())
                for col, value in zip(out, (kept.decode("utf-8", "ignore"), len(data), lost, runs, hashlib.sha256(kept).hexdigest())):
                    col.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(out, kinds)], *batch.columns[2:]], ["text", *results, *batch.schema.names[2:]])

    schema = ", ".join(["text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", *(f"c_{i} {f.dataType.simpleString()}" for i, f in enumerate(others))])
    done = joined.mapInArrow(strip, schema)
    back = {f.name: F.col(f"c_{i}").alias(f.name) for i, f in enumerate(others)} | {text_col: F.col("text").alias(text_col)}
    return done.select(*[back[c] for c in docs.columns], *results)


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats taken out of its texts; same rows, same columns."""
    return with_removals(docs, text_col).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Each document's bytes, removed bytes and spans, and the rest's digest; the cases are defined as in ``with_removals``."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_removals(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5_number(b[i:i + {SPAN - 1}]) AS k
  FROM (SELECT doc_id, b, unnest(range(1, n - {SPAN - 2})) AS i FROM d WHERE n >= {SPAN})
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1
), runs AS (
  SELECT doc_id, i, i + {SPAN} AS e, max(i + {SPAN}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM hit
), numbered AS (
  SELECT doc_id, i, e, sum(CASE WHEN p IS NULL OR i > p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM runs
), spans AS (
  SELECT doc_id, r, min(i) AS s, max(e) AS e FROM numbered GROUP BY doc_id, r
), gaps AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS g FROM spans
), kept AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS tail,
         string_agg(hex((SELECT b FROM d WHERE d.doc_id = gaps.doc_id)[g:s - 1]), '' ORDER BY s) AS parts
  FROM gaps GROUP BY doc_id
)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN n_removed IS NULL THEN sha256(b) ELSE sha256(unhex(parts || hex(b[tail:n]))) END AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
