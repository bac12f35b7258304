"""Texts as chunks that tokenize on their own, each distinct one coded once per worker.

The public pattern (public_tokenizers.PATTERN) takes runs of letters, of digits
or of other signs, each with at most one space before it, and white space. So a
text may be cut where such a run ends, and before each space unless white space
stands on both sides of it. Of white space before something else the pattern
leaves the last character to itself, so there is a cut before and behind it. Cutting, finding the distinct chunks and putting
their codes together are array operations; Python sees a distinct chunk of a
batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker remembers between this many chunks and half of it, those used last.
REMEMBERED = 500_000
REMEMBERED_BYTES = 1 << 26
#: Texts of about so many bytes are coded at once.
BYTES_AT_ONCE = 12_000_000
_LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _WHITE, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _QUOTE
_CLASS[32] = _SPACE
_CLASS[9:14] = _WHITE
#: _ENDS[a, b]: a chunk ends between bytes of these classes. A quote may begin a contraction; beside bytes of other signs there is no cut, which is never wrong.
_ENDS = np.zeros((8, 8), bool)
_ENDS[_LETTER, [_DIGIT, _SIGN, _QUOTE, _WHITE]] = True
_ENDS[_DIGIT, [_LETTER, _SIGN, _QUOTE, _WHITE]] = True
_ENDS[_SIGN, [_LETTER, _DIGIT, _WHITE]] = True
_ENDS[_WHITE, [_LETTER, _DIGIT, _SIGN, _QUOTE]] = True
_ENDS = _ENDS.ravel()
#: Bytes that may end, or begin, a white space character.
_MAY_END, _MAY_BEGIN = np.zeros(256, bool), np.zeros(256, bool)
_MAY_END[[*range(9, 14), *range(28, 33), 0x85, 0x9F, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]] = True
_MAY_BEGIN[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an array of strings; null is empty."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return at - at[0], held


def cut(texts: pa.Array, apart: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(chunks, firsts): the chunks of all texts in order, and the number of chunks before each text and at the end; texts ``apart`` are one chunk."""
    offsets, data = _parts(texts)
    n = len(data)
    if n == 0:
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    kind = _kinds(data)
    edge = np.zeros(n + 1, bool)
    ends = _ENDS[kind[:-1] << 3 | kind[1:]]
    edge[1:-1] = ends
    before = ends & (kind[:-1] == _WHITE)
    before[offsets[(offsets > 0) & (offsets < n)] - 1] = False  # what follows is another text
    edge[:-2] |= before
    at = np.flatnonzero(data == 32)
    after = _MAY_BEGIN[data[np.minimum(at + 1, n - 1)]]
    # A space that ends its text has nothing behind it to belong to.
    last = np.searchsorted(at, offsets[1:] - 1)
    found = last < len(at)
    found[found] = at[last[found]] == (offsets[1:] - 1)[found]
    after[last[found]] = True
    edge[at[~(_MAY_END[data[at - 1]] & after)]] = True
    for i in np.flatnonzero(apart) if apart is not None else ():
        edge[offsets[i] : offsets[i + 1]] = False
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    chunks = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])
    return chunks, np.searchsorted(edges, offsets)


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte."""
    kind = _CLASS[data]
    # Letters of two bytes whose first is C3: all but the signs for times and divided by.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] | 0x20) != 0xB7]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def one_run(chunks: pa.Array) -> np.ndarray:
    """Which of the chunks, as ``cut`` makes them, are one run of letters, digits or signs with at most one space before it."""
    offsets, data = _parts(chunks)
    kind = _kinds(data)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    # Where the class changes ``cut`` has cut, so what is neither in doubt nor a space inside is one run.
    doubt = np.concatenate(([0], np.cumsum((kind >= _QUOTE) & ~((kind == _SPACE) & first[:-1]))))
    size = np.diff(offsets)
    return (doubt[offsets[1:]] == doubt[offsets[:-1]]) & (size > (data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] == 32) if len(data) else size > 0)


class ChunkCodes:
    """Codes of texts; ``code`` gets distinct new chunks, and which of them are a single run, and returns for each its ids as little-endian 32-bit integers, and the bytes they stand for (or None). Texts that hold one of the strings ``whole`` are not cut."""

    def __init__(self, code: Callable[[list[bytes], list[bool]], list[tuple[bytes, bytes | None]]], whole: Iterable[bytes] = ()):
        self.code = code
        self.whole = tuple(whole)
        self.recent: dict[bytes, tuple[bytes, bytes | None]] = {}
        self.older: dict[bytes, tuple[bytes, bytes | None]] = {}
        self.held = 0

    def _codes(self, distinct: pa.Array) -> list[tuple[bytes, bytes | None]]:
        recent, older, chunks = self.recent, self.older, distinct.to_pylist()
        missing = [c for c in chunks if c not in recent]
        if missing:
            fresh = [c for c in missing if c not in older]
            recent.update({c: older[c] for c in missing if c in older})
            if fresh:
                single = dict(zip(chunks, one_run(distinct).tolist()))
                recent.update(zip(fresh, self.code(fresh, [single[c] for c in fresh])))
            self.held += sum(map(len, missing))
        out = [recent[c] for c in chunks]
        if len(recent) > REMEMBERED // 2 or self.held > REMEMBERED_BYTES // 2:
            self.recent, self.older, self.held = {}, recent, 0
        return out

    def values(self, texts: pa.Array, decode: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
        """(ends, ids, decoded): ids of all texts in order, the number of them before each text and at the end; decoded bytes of each text."""
        apart = np.zeros(len(texts), bool)
        for x in self.whole:
            apart |= pc.match_substring(texts.cast(pa.binary()).fill_null(b""), x).to_numpy(zero_copy_only=False)
        chunks, firsts = cut(texts, apart)
        coded = chunks.dictionary_encode()
        codes = self._codes(coded.dictionary)

        def joined(part: int) -> tuple[np.ndarray, pa.Buffer]:
            """The codes of all chunks in a row, and where each text's begin."""
            _, offsets, data = pa.array([c[part] for c in codes], pa.large_binary()).take(coded.indices).buffers()
            return np.frombuffer(offsets, np.int64)[firsts], data if data is not None else pa.py_buffer(b"")

        ends, ids = joined(0)
        if not decode:
            return ends // 4, np.frombuffer(ids, "<u4", ends[-1] // 4), None
        stops, data = joined(1)
        decoded = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(stops)), data])
        return ends // 4, np.frombuffer(ids, "<u4", ends[-1] // 4), decoded.cast(pa.binary())


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about BYTES_AT_ONCE of text; a longer text is a piece of its own."""
    if not batch.num_rows:
        return
    offsets, _ = _parts(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BYTES_AT_ONCE, side="right")) - 1)
        yield batch.slice(begin, stop - begin)
        begin = stop
