"""Byte-level BPE with DuckDB recursive queries, a connection per task.

A text is split by the tokenizer's pattern; pieces that are no token themselves become
rows (piece, position, token), starting with their bytes. Each step of the recursive
query joins neighbours with the merge table, finds each piece's leftmost pair of minimum
rank and contracts it, until no piece has a pair left. Pieces are encoded once per task
and looked up after that. Decoding joins ids with the vocabulary and aggregates their
bytes in order of position. A long text is encoded and decoded a slice at a time, so the
queries' memory does not follow its length.

A step of the recursion is one merge, so pieces over ``LONG_PIECE`` bytes would take as
many steps; they are contracted by a heap instead, with the same result. The query keeps the
rows of all its steps, at most the square of a piece's bytes, so a chunk of pieces is
closed by the sum of these squares as well as by their number.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_PIECE = 64
CHUNK_PIECES = 16_384
CHUNK_SQUARES = 1 << 23
CHUNK_CHARS = 1 << 20
#: Matches of a long text and ids of any texts that are held at a time.
CHUNK_MATCHES, SLICE_IDS = 1 << 18, 1 << 18
KEPT_PIECES = 400_000

_ENCODE = """
WITH RECURSIVE t(step, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM start
  UNION ALL
  SELECT t.step + 1, t.w, t.pos - (t.pos > b.pos)::INT, CASE WHEN t.pos = b.pos THEN b.made ELSE t.tok END
  FROM t JOIN (
    SELECT w, (pair & 65535)::INT AS pos, (pair >> 16)::INT AS made FROM (
      SELECT t.w, min(m.made::BIGINT << 16 | t.pos) AS pair
      FROM t JOIN t n ON n.w = t.w AND n.pos = t.pos + 1 JOIN merges m ON m.a = t.tok AND m.b = n.tok
      GROUP BY t.w)
  ) b ON b.w = t.w
  WHERE t.pos <> b.pos + 1
)
SELECT w, tok FROM t SEMI JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY w, pos
"""
_DECODE = "SELECT doc, string_agg(v.hex, '' ORDER BY pos) AS hex FROM ids JOIN vocab v USING (id) GROUP BY doc"
# Every way to make a token of two tokens; its rank decides the order of merging.
_MERGES = """
SELECT a.id AS a, b.id AS b, v.id AS made
FROM (SELECT hex, id, unnest(generate_series(2, length(hex) - 2, 2)) AS k FROM vocab WHERE length(hex) > 2) v
JOIN vocab a ON a.hex = v.hex[1:k] JOIN vocab b ON b.hex = v.hex[k + 1:]
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids, which are their ranks, of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})


class Codec:
    """Encodes and decodes in one task."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table, pattern: str) -> None:
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.sql = _connection()
        vocab = pa.table({"hex": [t.hex() for t in ranks], "id": pa.array(list(ranks.values()), pa.int32())})
        for name, rows in (("vocab", vocab), ("merges", merges)):
            self.sql.register("given", rows)
            self.sql.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.sql.unregister("given")

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern in order; those of a long text a part at a time."""
        if len(text) <= CHUNK_CHARS:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, CHUNK_MATCHES)):
            yield part

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = [bytearray() for _ in texts]
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for i, text in enumerate(texts):
            for part in self.pieces(text):
                held.append((i, part))
                chars += len(text) if len(text) <= CHUNK_CHARS else CHUNK_CHARS
                if chars >= CHUNK_CHARS:
                    self._add(out, held)
                    held, chars = [], 0
        self._add(out, held)
        return [bytes(x) for x in out]

    def _add(self, out: list[bytearray], held: list[tuple[int, list[str]]]) -> None:
        """The ids of some pieces, to the texts they are of."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        self._learn({p for _, pieces in held for p in pieces} - self.known.keys())
        get = self.known.__getitem__
        for i, pieces in held:
            out[i] += b"".join(map(get, pieces))

    def _learn(self, pieces: set[str]) -> None:
        todo: list[tuple[str, bytes]] = []
        for piece in pieces:
            raw = piece.encode()
            if (token := self.ranks.get(raw)) is not None:
                self.known[piece] = token.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.known[piece] = np.array(merge_long(raw, self.ranks), "<u4").tobytes()
            else:
                todo.append((piece, raw))
        todo.sort()
        for chunk in _chunks(todo):
            sizes = np.array([len(raw) for _, raw in chunk])
            word = np.repeat(np.arange(len(chunk), dtype=np.int32), sizes)
            place = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            tokens = self.bytes[np.frombuffer(b"".join(raw for _, raw in chunk), np.uint8)]
            self.sql.register("start", pa.table({"w": word, "pos": place, "tok": tokens}))
            got = self.sql.execute(_ENCODE).fetchnumpy()
            self.sql.unregister("start")
            ids, ends = np.asarray(got["tok"]).astype("<u4"), np.searchsorted(np.asarray(got["w"]), np.arange(len(chunk) + 1)) * 4
            raw_ids = ids.tobytes()
            for (piece, _), a, b in zip(chunk, ends, ends[1:], strict=False):
                self.known[piece] = raw_ids[a:b]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids: slices of all lists in order, so that a list may be of any length."""
        out = [bytearray() for _ in encoded]
        ends = np.cumsum([len(x) // 4 for x in encoded])
        ids = np.frombuffer(b"".join(encoded), "<u4")
        for begin in range(0, len(ids), SLICE_IDS):
            place = np.arange(begin, min(begin + SLICE_IDS, len(ids)))
            of = np.searchsorted(ends, place, side="right").astype(np.int32)
            for i, raw in self._decode(of, place, ids[place].astype(np.int64)):
                out[i] += bytes.fromhex(raw)
        return [bytes(x) for x in out]

    def _decode(self, of: np.ndarray, place: np.ndarray, ids: np.ndarray) -> list[tuple[int, str]]:
        if ids.max() >= len(self.ranks):
            raise ValueError("an id is not in the vocabulary")
        self.sql.register("ids", pa.table({"doc": of, "pos": place, "id": ids}))
        found = self.sql.execute(_DECODE).fetchall()
        self.sql.unregister("ids")
        return found


def _chunks(pieces: list[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
    """The pieces in order, at most ``CHUNK_PIECES`` and ``CHUNK_SQUARES`` bytes squared at a time."""
    begin = squares = 0
    for end, (_, raw) in enumerate(pieces):
        squares += len(raw) ** 2
        if end - begin == CHUNK_PIECES or squares > CHUNK_SQUARES:
            yield pieces[begin:end]
            begin, squares = end, len(raw) ** 2
    if pieces:
        yield pieces[begin:]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The leftmost pair of minimum rank contracted until none is left, by a heap."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != rank:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
    return [ranks[p] for p in parts if p is not None]


def _codec(ranks: dict[bytes, int], pattern: str):
    """Makes a codec in a task; the merge table is made here, once."""
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, ... and hold every byte")
    sql = _connection()
    sql.register("vocab", pa.table({"hex": [t.hex() for t in ranks], "id": pa.array(list(ranks.values()), pa.int32())}))
    merges = sql.sql(_MERGES).to_arrow_table()
    sql.close()
    return lambda: Codec(ranks, merges, pattern)  # DuckDB's objects stay where they are made


def _mapped(rows: DataFrame, new: str, ranks: dict[bytes, int], pattern: str, step) -> DataFrame:
    """The first column and the ``new`` binary ones, made by ``step(codec, values)`` of the second column."""
    make = _codec(ranks, pattern)
    names, id_column = new.split(", "), rows.columns[0]
    schema = rows.select(F.col(id_column), *[F.lit(None).cast("binary").alias(n) for n in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                made = step(codec, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(m, pa.binary()) for m in made]], [id_column, *names])

    return rows.mapInArrow(run, schema)


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id_column`` and ``ids``, little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Rows are independent, so repeated rows give
    repeated results; null ids stay; other columns are not read.
    """
    rows = documents.select(id_column, text_column)
    return _mapped(rows, "ids", ranks, pattern, lambda codec, texts: [codec.encode([t or "" for t in texts])])


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per input row: ``id_column`` and ``decoded``, the bytes of its ids; null ids are none."""
    rows = encoded.select(id_column, ids_column)
    return _mapped(rows, "decoded", ranks, pattern, lambda codec, ids: [codec.decode([i or b"" for i in ids])])


def round_trip(documents: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one task: ``id_column``, ``ids`` and ``decoded``."""

    def step(codec, texts: list[str | None]) -> list[list[bytes]]:
        ids = codec.encode([t or "" for t in texts])
        return [ids, codec.decode(ids)]

    return _mapped(documents.select(id_column, text_column), "ids, decoded", ranks, pattern, step)
