"""Token ids in compressed binary files: an adaptive context-mixing range coder.

Ids are cut into blocks of BLOCK_IDS. Each block is coded by itself: its models
start afresh, and its ids' CRC-32 is checked when it is read, so a damaged block
is found and costs no other. Within a block, an order-2 context (the two ids
before) and an order-1 context each predict one id. Their confidences and the
recent hit rate (order 0) are mixed by a logistic mixer, whose weights are
learned as the block goes on, into the probability of a hit; a miss is coded by an adaptive order-0 model of the id's
bit length and its remaining bits. A range coder turns each choice into bytes;
carries are kept beside its words and added at the end. All arithmetic gives
exact integers, so files do not depend on a machine's floating point. Up to
LANES blocks of a shard are coded side by side in numpy.

A file is a Parquet table whose rows are shards of whole documents, about
SHARD_IDS ids each, in id order. A shard is one binary value:

    magic "LTOK", version u16, documents u32, blocks u32
    per document: id i64 (the sentinel for null: -2^63), ids u32
    per block: ids u32, words u32, CRC-32 u32
    the blocks' words, u32 each, little-endian as everything else
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listaro.llm.chunks import ChunkCodes, slices
from listaro.staging import read_table, shuffle_width, stage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
BLOCK_IDS = 1024
#: Ids of a shard, but for a document that has more.
SHARD_IDS = 1 << 21
MAGIC = b"LTOK"
_NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sHII")
#: Blocks coded side by side; it bounds the coder's memory, however long a document.
LANES = 2048
#: The scale of a choice, and the least that its last part keeps. The coder's range is from 2^32 to 2^64.
_TOTAL = 1 << 16
_KEPT = 1 << 12
_WIDE = np.uint64(1 << 32)
_U16, _U32 = np.uint64(16), np.uint64(32)
_CLASSES = 18
_SLOTS2, _SLOTS1 = 512, 256
#: Steps after which the choices' sizes follow what was counted.
_FRESH = 128
#: stretch(p) = ln(p / (1 - p)) * 256 and its inverse, as integer tables over p in 1/4096.
_STRETCH = np.round(np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096))) * 256).astype(np.int32)
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 8, 4088).astype(np.int32)
#: Bit lengths of ids below 2^17.
_LENGTH = np.frexp(np.arange(1 << 17).astype(np.float64))[1].astype(np.int64)


class _Model:
    """The models of ``lanes`` blocks; step t works on the first k lanes.

    How often predictions of each confidence held is counted all the time; every
    _FRESH steps the counts become probabilities, mixed in the logistic domain
    with weights that follow the gradient of what was seen since.
    """

    def __init__(self, lanes: int):
        self.pred2 = np.zeros(lanes * _SLOTS2, np.int32)  # id << 2 | confidence, 0: none
        self.pred1 = np.zeros(lanes * _SLOTS1, np.int32)
        # Per lane and context (confidence of order 2, whether order 1 agrees): hits << 16 | trials of order 2; the same of order 1 by its confidence.
        self.tried2 = np.zeros(lanes * 8, np.int32)
        self.tried1 = np.zeros(lanes * 4, np.int32)
        self.size2_of = np.zeros(lanes * 8, np.int32)
        self.rate1_of = np.zeros(lanes * 4, np.int32)
        self.total2, self.total1 = np.zeros((2, lanes, 8), np.int32), np.zeros((2, lanes, 4), np.int32)
        self.weights = np.full((lanes, 3), 1 << 14, np.int32)
        self.inputs, self.mixed = None, None
        self.seen = np.ones((_CLASSES, lanes), np.int32)
        self.seen_flat = self.seen.ravel()
        self.cum = np.zeros((_CLASSES + 1, lanes), np.int16)
        self.cum_flat = self.cum.ravel()
        self.last = np.zeros(lanes, np.int64)
        self.mixed2 = np.zeros(lanes, np.int64)
        self.lane = np.arange(lanes)
        self.lane8, self.lane4, self.at2, self.at1 = self.lane * 8, self.lane * 4, self.lane * _SLOTS2, self.lane * _SLOTS1
        self.step = 0

    def _renew(self) -> None:
        """Probabilities and weights after what was seen since the last time."""
        np.cumsum(self.seen * (4096 - _CLASSES) // self.seen.sum(axis=0) + 1, axis=0, out=self.cum[1:], dtype=np.int16)
        tried2, tried1 = self.tried2.reshape(-1, 8), self.tried1.reshape(-1, 4)
        new2, new1 = (tried2 >> 16, tried2 & 65535), (tried1 >> 16, tried1 & 65535)
        if self.inputs is not None:
            # Per context: hits less the hits that were expected, in 1/4096.
            miss = (new2[0] << 12) - new2[1] * self.mixed
            for i, x in enumerate(self.inputs):
                self.weights[:, i] += (x * miss >> 12).sum(axis=1, dtype=np.int32)
            np.clip(self.weights, -(1 << 18), 1 << 18, out=self.weights)
        for total, new in ((self.total2, new2), (self.total1, new1)):
            total -= total >> 2
            total[0] += new[0] << 8
            total[1] += new[1] << 8

        def rate(hits: np.ndarray, trials: np.ndarray) -> np.ndarray:
            return (hits * 8 + 512) // (trials // 512 + 2)

        own = np.minimum(rate(*self.total2), 4095)
        below = np.minimum(rate(*self.total1), 4095)
        recent = np.minimum(rate(*self.total2.sum(axis=2)), 4095)
        agree = _STRETCH[np.minimum(rate(self.total1[0].sum(axis=1), self.total1[1].sum(axis=1)), 4095)]
        self.inputs = (_STRETCH[own], agree[:, None] * np.array([0, 1] * 4, np.int32), np.repeat(_STRETCH[recent][:, None], 8, axis=1))
        dot = sum(self.weights[:, i : i + 1] * x for i, x in enumerate(self.inputs)) >> 16
        self.mixed = _SQUASH[np.clip(dot, -2047, 2047) + 2047]
        size2 = self.mixed * 15
        size2[:, :2] = 0  # confidence 0: no prediction
        self.size2_of[:] = size2.ravel()
        below = np.clip(below, 8, 4088)
        below[:, 0] = 0
        self.rate1_of[:] = below.ravel()
        self.tried2[:] = 0
        self.tried1[:] = 0

    def predict(self, k: int) -> None:
        """The sizes of the choices: an order-2 hit (size2), an order-1 hit (up to from0), and the rest, shared by the bit lengths (order 0)."""
        if self.step % _FRESH == 0:
            self._renew()
        self.step += 1
        self.slot2 = self.at2[:k] + ((self.mixed2[:k] + self.last[:k] * 2654435761 >> 9) & (_SLOTS2 - 1))
        np.multiply(self.last[:k], 40503, out=self.mixed2[:k])  # also what the next step mixes in for the id before
        self.slot1 = self.at1[:k] + ((self.mixed2[:k] >> 4) & (_SLOTS1 - 1))
        self.p2, self.p1 = p2, p1 = self.pred2[self.slot2], self.pred1[self.slot1]
        self.id2, self.id1 = p2 >> 2, p1 >> 2
        self.s2, self.s1 = p2 & 3, p1 & 3
        agree = self.id1 == self.id2
        self.c2 = self.lane8[:k] + (self.s2 * 2 + agree)
        self.c1 = self.lane4[:k] + self.s1
        self.size2 = self.size2_of[self.c2]
        # Order 1 takes a share of what is left, unless it says the same.
        share = (_TOTAL - _KEPT - self.size2) * self.rate1_of[self.c1] >> 12
        self.from0 = self.size2 + share * ~agree
        self.rest = _TOTAL - self.from0

    def choice(self, hit2: np.ndarray, hit1: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of what each lane chooses: a hit of order 2 or 1, or else the bit length of its id."""
        at = length * len(self.lane) + self.lane[: len(length)]
        low = self.from0 + (self.cum_flat[at] * self.rest >> 12)
        high = self.from0 + (self.cum_flat[at + len(self.lane)] * self.rest >> 12)
        begin = np.where(hit2, 0, np.where(hit1, self.size2, low))
        end = np.where(hit2, self.size2, np.where(hit1, self.from0, high))
        return begin.astype(np.uint64), (end - begin).astype(np.uint64)

    def length_at(self, k: int, offset: np.ndarray) -> np.ndarray:
        """The bit length whose share of the rest holds ``offset``, in each lane."""
        # cum * rest >> 12 is at most the offset where cum is at most this:
        bound = ((np.maximum(offset, 0) + 1 << 12) - 1) // self.rest
        bound = bound.astype(np.int16)
        found, within = np.zeros(k, np.int8), np.empty(k, bool)
        for c in range(1, _CLASSES):
            np.less_equal(self.cum[c, :k], bound, out=within)
            np.add(found, within.view(np.int8), out=found)
        return found.astype(np.int64)

    def update(self, ids: np.ndarray, length: np.ndarray, literal: np.ndarray) -> None:
        """Learn from the ids and their bit lengths; ``literal``: where neither prediction hit."""
        k = len(ids)
        right2, right1 = self.id2 == ids, self.id1 == ids
        self.tried2[self.c2] += right2 * np.int32(65536) + np.int32(1)
        self.tried1[self.c1] += right1 * np.int32(65536) + np.int32(1)
        self.seen_flat[length * len(self.lane) + self.lane[:k]] += literal * np.int32(8)
        fresh = ids << 2 | 1
        for table, slot, p, sure, right in ((self.pred2, self.slot2, self.p2, self.s2, right2), (self.pred1, self.slot1, self.p1, self.s1, right1)):
            # A hit makes surer, a miss less sure; a prediction that is not sure gives way.
            table[slot] = np.where(right & (sure > 0), p + (sure < 3), np.where(sure > 1, p - 1, fresh))
        self.last[:k] = ids


def _lanes(lengths: list[int]) -> tuple[np.ndarray, list[int]]:
    """(order of the blocks, longest first; number of blocks longer than t for each step t)."""
    order = np.argsort(-np.array(lengths), kind="stable")
    sorted_lengths = np.array(lengths)[order]
    steps = int(sorted_lengths[0]) if len(lengths) else 0
    return order, np.searchsorted(-sorted_lengths, -np.arange(steps), side="left").tolist()


def _encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    order, alive = _lanes([len(b) for b in blocks])
    n, steps = len(blocks), len(alive)
    by_lane = np.zeros((n, steps), np.int32)
    for lane, i in enumerate(order.tolist()):
        by_lane[lane, : len(blocks[i])] = blocks[i]
    ids = np.ascontiguousarray(by_lane.T)
    model = _Model(n)
    low, size = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    # Words lie by place, then by lane. They hold 32 bits, and carries above them until the end.
    words, used = np.zeros((steps + 3) * n, np.int64), np.zeros(n, np.int64)

    for t in range(steps):
        k = alive[t]
        now, lo, sz = ids[t, :k], low[:k], size[:k]
        model.predict(k)
        length = _LENGTH[now]
        hit2 = (model.size2 > 0) & (model.id2 == now)
        hit1 = (model.from0 > model.size2) & (model.id1 == now)
        literal = ~(hit2 | hit1)
        begin, width = model.choice(hit2, hit1, length)
        unit = sz >> _U16
        # The bits below the first of an id that neither prediction hit follow as they are.
        bits = np.maximum(length - 1, 0) * literal
        part = width * unit >> bits.astype(np.uint64)
        more = begin * unit + (now & ((1 << bits) - 1)).astype(np.uint64) * part
        lo += more
        over = np.flatnonzero(lo < more)
        if len(over):
            words[(used[over] - 1) * n + over] += 1
        sz[:] = part
        go = np.flatnonzero(part < _WIDE)
        top = lo[go]
        words[used[go] * n + go] = (top >> _U32).astype(np.int64)
        used[go] += 1
        lo[go] = top << _U32
        sz[go] <<= _U32
        model.update(now, length, literal)
    for _ in range(2):
        words[used * n + model.lane] = (low >> _U32).astype(np.int64)
        used += 1
        low <<= _U32
    table = words.reshape(-1, n)
    for i in range(len(table) - 1, 0, -1):
        table[i - 1] += table[i] >> 32
    coded = np.ascontiguousarray(table.astype("<u4").T)
    out: list[bytes] = [b""] * n
    for lane, (i, count) in enumerate(zip(order.tolist(), used.tolist())):
        out[i] = coded[lane, :count].tobytes()
    return out


def _decode_lanes(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    order, alive = _lanes(lengths)
    n, steps = len(coded), len(alive)
    most = max([len(c) // 4 for c in coded], default=0) + 2
    by_lane = np.zeros((n, most), np.uint32)
    for lane, i in enumerate(order.tolist()):
        got = np.frombuffer(coded[i], "<u4")
        by_lane[lane, : len(got)] = got
    words = np.ascontiguousarray(by_lane.T).ravel()
    model = _Model(n)
    # The code is held less the lower end of the range.
    code = words[model.lane].astype(np.uint64) << _U32 | words[model.lane + n]
    size, used = np.full(n, (1 << 64) - 1, np.uint64), np.full(n, 2, np.int64)
    ids = np.zeros((steps, n), np.int32)

    for t in range(steps):
        k = alive[t]
        cd, sz = code[:k], size[:k]
        model.predict(k)
        unit = sz >> _U16
        value = np.minimum(cd // unit, np.uint64(_TOTAL - 1)).astype(np.int32)
        hit2 = value < model.size2
        literal = value >= model.from0
        hit1 = ~(hit2 | literal)
        length = model.length_at(k, value - model.from0) * literal
        begin, width = model.choice(hit2, hit1, length)
        bits = np.maximum(length - 1, 0)
        part = width * unit >> bits.astype(np.uint64)
        cd -= begin * unit
        extra = np.minimum(cd // part, ((1 << bits) - 1).astype(np.uint64))
        cd -= extra * part
        sz[:] = part
        now = np.where(hit2, model.id2, np.where(hit1, model.id1, (extra.astype(np.int64) | ((length > 0) << bits)).astype(np.int32)))
        go = np.flatnonzero(part < _WIDE)
        cd[go] = cd[go] << _U32 | words[np.minimum(used[go], most - 1) * n + go]
        used[go] += 1
        sz[go] <<= _U32
        ids[t, :k] = now
        model.update(now, length, literal)
    out: list[np.ndarray] = [np.empty(0, np.int32)] * n
    columns = np.ascontiguousarray(ids.T)
    for lane, i in enumerate(order.tolist()):
        out[i] = columns[lane, : lengths[i]]
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded words of each block of ids (non-negative, below 2^17)."""
    return [c for i in range(0, len(blocks), LANES) for c in _encode_lanes(blocks[i : i + LANES])]


def decode_blocks(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    return [b for i in range(0, len(coded), LANES) for b in _decode_lanes(coded[i : i + LANES], lengths[i : i + LANES])]


def write_shard(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    """A shard of documents' ids (little-endian 32-bit integers), in the file format."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    coded = encode_blocks(blocks)
    index = np.array([(_NO_ID if d is None else d, len(x) // 4) for d, x in zip(doc_ids, docs)], "<i8,<u4")
    directory = np.array([(len(b), len(c) // 4, zlib.crc32(b.tobytes())) for b, c in zip(blocks, coded)], "<u4,<u4,<u4")
    return _HEAD.pack(MAGIC, 2, len(docs), len(blocks)) + index.tobytes() + directory.tobytes() + b"".join(coded)


def read_shard(data: bytes) -> tuple[list[int | None], list[bytes]]:
    """(document ids, their token ids as little-endian 32-bit integers); raises ValueError on damage."""
    magic, version, n_docs, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 2:
        raise ValueError("not a token shard")
    at = _HEAD.size
    index = np.frombuffer(data, "<i8,<u4", n_docs, at)
    at += index.nbytes
    directory = np.frombuffer(data, "<u4,<u4,<u4", n_blocks, at)
    at += directory.nbytes
    ends = at + 4 * np.concatenate(([0], np.cumsum(directory["f1"].astype(np.int64))))
    blocks = decode_blocks([data[a:b] for a, b in zip(ends, ends[1:])], directory["f0"].astype(int).tolist())
    blocks = [b.astype("<u4").tobytes() for b in blocks]
    for i, (block, crc) in enumerate(zip(blocks, directory["f2"].tolist())):
        if zlib.crc32(block) != crc:
            raise ValueError(f"block {i} is damaged")
    flat = b"".join(blocks)
    stops = 4 * np.concatenate(([0], np.cumsum(index["f1"].astype(np.int64))))
    return [None if d == _NO_ID else d for d in index["f0"].tolist()], [flat[a:b] for a, b in zip(stops, stops[1:])]


class _Tokenizer:
    """The tokenizers library on distinct chunks; one per worker process and vocabulary."""

    _made: dict[str, ChunkCodes] = {}

    @classmethod
    def of(cls, path: str) -> ChunkCodes:
        if path not in cls._made:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)

            def ids(texts: list[str]) -> list[np.ndarray]:
                return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

            line_end = ids(["\n"])[0]

            def code(chunks: list[bytes], single: list[bool]) -> list[tuple[bytes, None]]:
                # Single runs are coded many at a time, on lines of their own: each line end is one id.
                plain = [c for c, one in zip(chunks, single) if one]
                coded: dict[bytes, bytes] = {}
                groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)] if len(line_end) == 1 else []
                for group, found in zip(groups, ids([b"\n".join(g).decode() for g in groups])):
                    stops = np.flatnonzero(found == line_end[0])
                    if len(stops) == len(group) - 1:
                        flat = found.tobytes()
                        edges = [0, *(4 * stops + 4).tolist(), len(flat) + 4]
                        coded.update((c, flat[a : b - 4]) for c, a, b in zip(group, edges, edges[1:]))
                rest = [c for c in chunks if c not in coded]
                coded.update((c, x.tobytes()) for c, x in zip(rest, ids([c.decode("utf-8", "replace") for c in rest])))
                return [(coded[c], None) for c in chunks]

            # The library finds added tokens before it cuts a text into words, so no such text may be cut here.
            cls._made[path] = ChunkCodes(code, [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()])
        return cls._made[path]


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write the token ids of all documents to files in ascending id order; returns a reader of the files.

    Columns: part (place of the file's range of ids), first (ids of the part
    before this shard), n_tokens, shard. Documents are dealt by ranges of ids,
    so the files in order of part and first hold all in order; null ids come first,
    and rows of equal ids are in the order of their texts.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codes, part, first = _Tokenizer.of(vocabulary), TaskContext.get().partitionId(), 0
        held_ids: list[int | None] = []
        held: list[bytes] = []
        held_n = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, first, held_n)] + [pa.array([write_shard(held_ids, held)], pa.binary())], ["part", "first", "n_tokens", "shard"])

        for batch in batches:
            for piece in slices(batch, 1):
                ends, flat, _ = codes.values(piece.column(1))
                for doc_id, lo, hi in zip(piece.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    data = flat[lo:hi].tobytes() + end
                    n = len(data) // 4
                    if held and held_n + n > SHARD_IDS:
                        yield flush()
                        first, held_n = first + held_n, 0
                        held_ids.clear()
                        held.clear()
                    held_ids.append(doc_id)
                    held.append(data)
                    held_n += n
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dealt = rows.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return stage(dealt.mapInArrow(run, "part bigint, first bigint, n_tokens bigint, shard binary"), "token-files", rebalance=False)


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids): each document of the files, with the number of ids before it, and its ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, shard in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, ids = read_shard(shard.as_py())
                starts = start + np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))[:-1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    # One row per part, so as few as a shuffle has partitions.
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
    shards = files.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("first")).alias("start"), "shard")
    return shards.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Defined cases: null and empty texts have the end id alone; repeated rows are each written; no other column is looked at."""
    files = write_tokens(read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return read_tokens(files).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
