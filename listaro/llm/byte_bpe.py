"""Byte-level BPE by recursive queries in DuckDB, per partition.

A task cuts its texts into chunks and those into the pattern's words, and keeps
the distinct new words. They become token-position rows in an in-process DuckDB;
a recursive query joins neighbours to the merge table and contracts each word's
leftmost pair of least rank, one per round, until no word has a pair left.
Ordered aggregation gives each word's ids, and decodes them to bytes again. The
texts' ids and bytes are those of their words, in order.

A long word would take a round for each of its bytes. It is first cut wherever
no token of the vocabulary can lie across, which no merge can cross either. Its
pieces contract all pairs of least rank in a round, from the left, unless the
token made could pair up at a lower rank, when the leftmost alone goes.

Memory is bounded by the words coded at once, the rounds of a query and the
chunks remembered, and no row leaves its task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listaro.llm.chunks import ChunkCodes, slices
from listaro.staging import read_table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Words that one recursive query codes.
WORDS_AT_ONCE = 50_000
#: Bytes of long pieces that one recursive query codes, but for a longer piece.
BYTES_AT_ONCE = 1 << 18
#: Rounds of one query over long pieces; those with pairs left go on in the next, so that no query holds more states.
ROUNDS = 32
#: A word of more bytes is long.
LONG = 48

CONTRACT = """
WITH RECURSIVE tokens AS (
  -- Each row also knows the place and the token to its right, so that a round needs no sort.
  SELECT w, pos, tok, lead(pos) OVER beside AS right_pos, lead(tok) OVER beside AS right_tok, 0 AS round
  FROM word_bytes WINDOW beside AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  SELECT t.w, t.pos,
         CASE WHEN t.pos = spot THEN merged ELSE t.tok END,
         CASE WHEN t.pos = spot THEN next_pos ELSE t.right_pos END,
         CASE WHEN t.pos = spot THEN next_tok WHEN t.right_pos = spot THEN merged ELSE t.right_tok END,
         t.round + 1
  FROM tokens t JOIN (
    SELECT best.w, merged, spot, gone, g.right_pos AS next_pos, g.right_tok AS next_tok
    FROM (
      SELECT w, least_pair >> 32 AS merged, least_pair & 4294967295 AS spot, gone
      FROM (
        SELECT w, min((m << 32) | pos) AS least_pair, arg_min(right_pos, (m << 32) | pos) AS gone
        FROM tokens JOIN merges ON l = tok AND r = right_tok GROUP BY w
      )
    ) best JOIN tokens g ON g.w = best.w AND g.pos = gone
  ) contraction ON t.w = contraction.w
  WHERE t.pos <> gone
), settled AS (
  SELECT t.w, pos, tok FROM tokens t JOIN (SELECT w, max(round) AS final FROM tokens GROUP BY w) f ON t.w = f.w AND round = final
)
SELECT w, list(tok::INTEGER ORDER BY pos) AS ids, unhex(string_agg(bytes, '' ORDER BY pos)) AS bytes
FROM settled JOIN vocabulary ON id = tok GROUP BY w ORDER BY w
"""

#: The last states of long pieces after at most ROUNDS rounds of all pairs of least rank.
CONTRACT_LONG = f"""
WITH RECURSIVE tokens AS (
  SELECT w, pos, tok, lead(pos) OVER beside AS right_pos, lead(tok) OVER beside AS right_tok, 0 AS round
  FROM state WINDOW beside AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  (WITH pairs AS (
    SELECT w, pos, right_pos, m, alone, l = r AS twins FROM tokens JOIN merges ON l = tok AND r = right_tok WHERE round < {ROUNDS}
  ), least AS (
    SELECT p.* FROM pairs p JOIN (SELECT w, min(m) AS m FROM pairs GROUP BY w) USING (w, m)
  ), placed AS (
    SELECT *, row_number() OVER a AS nth, lag(right_pos) OVER a IS DISTINCT FROM pos AS opens FROM least WINDOW a AS (PARTITION BY w ORDER BY pos)
  ), runs AS (
    -- Of overlapping pairs of equal tokens every second one goes.
    SELECT *, nth - max(CASE WHEN opens THEN nth END) OVER (PARTITION BY w ORDER BY pos) AS within FROM placed
  ), spots AS (
    SELECT w, pos, right_pos AS gone, m AS merged FROM runs WHERE CASE WHEN alone THEN nth = 1 ELSE NOT twins OR within % 2 = 0 END
  )
  SELECT t.w, t.pos, coalesce(own.merged, t.tok),
         CASE WHEN own.w IS NULL THEN t.right_pos ELSE g.right_pos END,
         coalesce(beside.merged, CASE WHEN own.w IS NULL THEN t.right_tok ELSE g.right_tok END), t.round + 1
  FROM tokens t JOIN (SELECT DISTINCT w FROM spots) going ON going.w = t.w
  LEFT JOIN spots own ON own.w = t.w AND own.pos = t.pos
  LEFT JOIN tokens g ON g.w = own.w AND g.pos = own.gone
  LEFT JOIN spots beside ON beside.w = t.w AND beside.pos = CASE WHEN own.w IS NULL THEN t.right_pos ELSE g.right_pos END
  LEFT JOIN spots taken ON taken.w = t.w AND taken.gone = t.pos
  WHERE taken.w IS NULL)
)
SELECT t.w, pos, tok::BIGINT AS tok, round FROM tokens t JOIN (SELECT w, max(round) AS final FROM tokens GROUP BY w) f ON t.w = f.w AND round = final
"""

READ_OUT = """
SELECT w, list(tok::INTEGER ORDER BY pos) AS ids, unhex(string_agg(bytes, '' ORDER BY pos)) AS bytes
FROM state JOIN vocabulary ON id = tok GROUP BY w ORDER BY w
"""


class WordCoder:
    """Codes distinct words with a vocabulary of ranks; one per worker process and vocabulary."""

    _made: dict[str, "WordCoder"] = {}

    @classmethod
    def of(cls, path: str) -> "WordCoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        # Tokens that can be part of one of lower rank; where one is made, the next pair of least rank may be another.
        early = {x for a, b, r in pairs for x in (a, b) if x > r}
        pairs = [(*p, p[2] in early) for p in pairs]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = pa.table({n: pa.array(c, k) for n, c, k in zip(("l", "r", "m", "alone"), zip(*pairs), [pa.int64()] * 3 + [pa.bool_()])})  # noqa: F841  read by name
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "bytes": [t.hex() for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.spans = None
        self.codes = ChunkCodes(self.chunks)

    def _bytes_table(self, words: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        return pa.table({"w": np.repeat(np.arange(len(words)), sizes), "pos": np.arange(len(data)) - np.repeat(first, sizes), "tok": self.byte_ids[data]})

    @staticmethod
    def _read(found: pa.Table) -> list[tuple[bytes, bytes]]:
        ids, decoded = found.column("ids").combine_chunks(), found.column("bytes").to_pylist()
        flat, ends = np.asarray(ids.flatten(), "<i4").tobytes(), (np.asarray(ids.offsets) * 4).tolist()
        base = ends[0] if ends else 0
        return [(flat[a - base : b - base], d) for a, b, d in zip(ends, ends[1:], decoded)]

    def pieces(self, word: bytes) -> list[bytes]:
        """The word, cut where no token of two bytes or more lies across."""
        if self.spans is None:
            self.spans = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self.spans.add_word(token.decode("latin-1"), len(token))
            self.spans.make_automaton()
        change = np.zeros(len(word) + 1, np.int32)
        for end, size in self.spans.iter(word.decode("latin-1")):
            change[end - size + 2] += 1  # the token lies across the cuts before its second byte, and up to its last
            change[end + 1] -= 1
        cuts = (np.flatnonzero(np.cumsum(change)[1 : len(word)] == 0) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def contract(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded bytes) of each non-empty word of at most LONG bytes."""
        out = []
        for begin in range(0, len(words), WORDS_AT_ONCE):
            word_bytes = self._bytes_table(words[begin : begin + WORDS_AT_ONCE])  # noqa: F841
            out.extend(self._read(self.db.sql(CONTRACT).to_arrow_table()))
        return out

    def contract_long(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The same for long pieces."""
        out, begin = [], 0
        while begin < len(pieces):
            stop, held = begin + 1, len(pieces[begin])
            while stop < len(pieces) and held + len(pieces[stop]) <= BYTES_AT_ONCE:
                held += len(pieces[stop])
                stop += 1
            state = self._bytes_table(pieces[begin:stop])
            while True:
                found = self.db.sql(CONTRACT_LONG).to_arrow_table()
                state = found.select(["w", "pos", "tok"])
                if pc.max(found["round"]).as_py() < ROUNDS:
                    break
            out.extend(self._read(self.db.sql(READ_OUT).to_arrow_table()))
            begin = stop
        return out

    def coded_words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each word, of any length."""
        parts = {w: self.pieces(w) for w in words if len(w) > LONG}
        distinct = set(w for w in words if w not in parts).union(*parts.values())
        short, long = [p for p in distinct if len(p) <= LONG], [p for p in distinct if len(p) > LONG]
        coded = dict(zip(short, self.contract(short))) | dict(zip(long, self.contract_long(long)))
        return [coded[w] if w not in parts else tuple(b"".join([coded[p][i] for p in parts[w]]) for i in (0, 1)) for w in words]

    def chunks(self, chunks: list[bytes], single: list[bool]) -> list[tuple[bytes, bytes]]:
        """The same for chunks, each of one or more words of the pattern."""
        cut = {c: [w.encode("utf-8", "surrogatepass") for w in self.words.findall(c.decode("utf-8", "surrogatepass"))] for c, one in zip(chunks, single) if not one}
        words = list(set(c for c in chunks if c not in cut).union(*cut.values()))
        coded = dict(zip(words, self.coded_words(words)))
        return [coded[c] if c not in cut else tuple(b"".join([coded[w][i] for w in cut[c]]) for i in (0, 1)) for c in chunks]


def with_ids(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``docs`` but the text, with ``ids`` (array<int>) and ``decoded`` (the bytes those ids stand for).

    Defined cases: null and empty texts have no ids; special tokens' strings are
    ordinary text; columns named ids or decoded are replaced; repeated rows are
    each coded; an empty table gives an empty result; a very long text is one
    piece of work, coded by its distinct words, and a very long word by its pieces. ``vocabulary`` is a rank file
    that every machine has.
    """
    others = [f for f in docs.schema.fields if f.name not in (text_col, "ids", "decoded")]
    width = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCoder.of(vocabulary).codes
        for batch in batches:
            for part in slices(batch, width):
                ends, ids, decoded = codes.values(part.column(width), decode=True)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, decoded], [*part.schema.names[:-1], "ids", "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "ids array<int>, decoded binary"])
    return docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as digests; the cases are defined as in ``with_ids``."""
    coded = with_ids(read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
