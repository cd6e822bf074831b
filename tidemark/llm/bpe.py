"""Byte-level BPE encoding and decoding with a given vocabulary (never trained here).

A text is cut into pre-tokens by a pattern and each pre-token is merged by rank. Texts of more than ``chunk_chars`` are cut
into overlapping chunks that are pre-tokenised in parallel: two neighbours are stitched at the first pre-token boundary
that both found in their overlap, for from a common boundary on the pattern, which looks only forward, goes on alike.
The pieces between such boundaries are then encoded in parallel. Decoding concatenates the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.workspace import materialise

CHUNK_CHARS, OVERLAP = 32_768, 1_024

#: The pattern's longest look past a match's end; boundaries nearer to a chunk's end than this may be due to the cut.
LOOK_AHEAD = 3

#: Pre-tokens of up to so many bytes are merged by scanning a list, longer ones with a heap.
SHORT = 64

#: Pre-tokens whose ids a worker remembers before it starts afresh.
REMEMBERED = 300_000

#: Stands for the rank of a pair that is not in the vocabulary.
NONE = 1 << 40

#: Rows whose ids a task holds before it passes them on.
ROWS = 500


class Vocabulary(dict):
    """Maps a pre-token to its ids as int32 bytes, remembering what it has worked out. ``raw``: lines of base64 bytes and rank."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        known = [self.ranks.get(bytes((a, b)), NONE) for a in range(256) for b in range(256)]
        self.first_pairs, self.single = known, [bytes((b,)) for b in range(256)]
        tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        pool = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        self.pool, self.lengths = np.frombuffer(b"".join(pool), np.uint8), np.array([len(t) for t in pool], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.merge(piece.encode()), np.int32).tobytes()
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Join the adjacent pair of lowest rank, the leftmost first, until no pair is in the vocabulary."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        if len(raw) <= SHORT:
            get, first = ranks.get, self.first_pairs
            parts = list(map(self.single.__getitem__, raw))
            pairs = [first[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)]
            while pairs and (least := min(pairs)) != NONE:
                i = pairs.index(least)
                joined = parts[i] = parts[i] + parts.pop(i + 1)
                del pairs[i]
                if i:
                    pairs[i - 1] = get(parts[i - 1] + joined, NONE)
                if i < len(pairs):
                    pairs[i] = get(joined + parts[i + 1], NONE)
            return list(map(ranks.__getitem__, parts))
        ends = list(range(1, len(raw) + 1))  # ends[i]: where the part that starts at i ends, 0 if none starts there
        before = list(range(-1, len(raw) - 1))
        queue = [(rank, i, i + 2) for i in range(len(raw) - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, start, end = heapq.heappop(queue)
            middle = ends[start]
            if not middle or middle >= len(raw) or ends[middle] != end:
                continue  # one of the two parts has been joined meanwhile
            ends[start], ends[middle] = end, 0
            if end < len(raw):
                before[end] = start
                if (rank := ranks.get(raw[start : ends[end]])) is not None:
                    heapq.heappush(queue, (rank, start, ends[end]))
            if (left := before[start]) >= 0 and (rank := ranks.get(raw[left:end])) is not None:
                heapq.heappush(queue, (rank, left, end))
        ids, at = [], 0
        while at < len(raw):
            ids.append(ranks[raw[at : ends[at]]])
            at = ends[at]
        return ids

    def encode(self, text: str, upto: int | None = None) -> np.ndarray:
        """The ids of ``text``, or of its pre-tokens up to the boundary ``upto``, with what follows as context only."""
        pieces = self.pattern.findall(text)
        if upto is not None:
            pieces = pieces[: np.searchsorted(np.cumsum([len(p) for p in pieces]), upto, side="right")]
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, concatenated: each is copied from its place in one pool of all tokens."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.begins[ids] - (ends - lengths), lengths)
        return self.pool[shift + np.arange(len(shift))].tobytes()


@lru_cache(maxsize=2)
def vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(raw, pattern)


def _ids_column(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


class ByteBpe:
    """Encoder and decoder for the vocabulary file at ``ranks_path``, which the driver reads and broadcasts."""

    def __init__(self, spark, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP):
        if not LOOK_AHEAD < overlap <= chunk_chars:
            raise ValueError("the overlap must be longer than the look-ahead and no longer than a chunk")
        self.raw, self.pattern = spark.sparkContext.broadcast(Path(ranks_path).read_bytes()), pattern
        self.chunk_chars, self.overlap = chunk_chars, overlap

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, ids (array<int>) for each row of ``docs``. Null and empty texts have no ids; other columns are ignored.

        Equal texts have equal ids; rows may repeat and ids may be null. An empty table gives no rows.
        """
        short, long = self._by_length(docs, id_col, text_col)
        return self._map(short, "doc_id").unionByName(self._joined_long(long))

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, ids, decoded: what ``decode`` gives of what ``encode`` gives. Texts of one chunk are decoded from their ids where these
        were made, so that a task needs one Python worker, with one vocabulary, and ids travel once."""
        short, long = self._by_length(docs, id_col, text_col)
        return self._map(short, "doc_id", decode=True).unionByName(self.decode(self._joined_long(long)))

    def _by_length(self, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        is_long = F.char_length("text") > self.chunk_chars
        return rows.where(~is_long), rows.where(is_long)

    def _joined_long(self, long: DataFrame) -> DataFrame:
        by_text = long.select("doc_id", F.sha2("text", 256).alias("key")).join(self._encode_long(long), "key")
        return by_text.select("doc_id", "ids")

    def _map(self, rows: DataFrame, key: str, decode: bool = False) -> DataFrame:
        raw, pattern = self.raw, self.pattern
        names = [key, "ids", *["decoded"] * decode]

        def run(batches):
            words = vocabulary(raw.value, pattern)
            for batch in batches:
                for part in (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS)):
                    ids = [words.encode(x.as_py()) for x in part.column(1)]
                    columns = [part.column(0), _ids_column(ids)]
                    if decode:
                        columns.append(pa.array([words.decode(x) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

        return rows.select(key, "text").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, ids array<int>" + ", decoded binary" * decode)

    def _encode_long(self, long: DataFrame) -> DataFrame:
        """key (the text's SHA-256), ids for each distinct text."""
        chunks = materialise(self._chunks(long.select(F.sha2("text", 256).alias("key"), "text")).dropDuplicates(["key", "chunk"]), "chunks")
        order = Window.partitionBy("key").orderBy("chunk")
        # Boundaries that both of two neighbours found in their overlap; the first is where the later one takes over.
        common = F.array_intersect("heads", F.lag("tails").over(order))
        found = self._boundaries(chunks).withColumn("begin", F.when(F.col("chunk") == 0, F.lit(0).cast("long")).otherwise(F.array_min(common)))
        found = found.withColumn("end", F.lead("begin").over(order)).withColumn("apart", F.max(F.col("begin").isNull()).over(Window.partitionBy("key")))
        found = materialise(found.select("key", "chunk", "begin", "end", "apart"), "seams")

        stitched = self._pieces(chunks.join(found.where("not apart"), ["key", "chunk"]))
        in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda p: p["ids"]))
        stitched = stitched.groupBy("key").agg(in_order.alias("ids"))
        # A text with a run of one pre-token longer than an overlap has no common boundary there: it is encoded whole.
        apart = found.where("apart").select("key").distinct()
        whole = long.select(F.sha2("text", 256).alias("key"), "text").join(apart, "key", "left_semi").dropDuplicates(["key"])
        return stitched.unionByName(self._map(whole, "key"))

    def _chunks(self, keyed: DataFrame) -> DataFrame:
        step, overlap = self.chunk_chars, self.overlap

        def run(batches):
            for batch in batches:
                for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    starts = range(0, max(1, len(text) - overlap), step)
                    for at in range(0, len(starts), 256):
                        some = starts[at : at + 256]
                        columns = [[key] * len(some), [s // step for s in some], [text[s : s + step + overlap] for s in some]]
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["key", "chunk", "text"])

        return keyed.mapInArrow(run, "key string, chunk long, text string")

    def _boundaries(self, chunks: DataFrame) -> DataFrame:
        """key, chunk, heads, tails: where pre-tokens begin in the overlap with the chunk before and with the one after."""
        raw, pattern, step, overlap = self.raw, self.pattern, self.chunk_chars, self.overlap

        def run(batches):
            words = vocabulary(raw.value, pattern)
            for batch in batches:
                heads, tails = [], []
                for chunk, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    ends = [m.end() for m in words.pattern.finditer(text)]
                    sure = [e for e in ends if e <= len(text) - LOOK_AHEAD]
                    heads.append([chunk * step + e for e in sure if e < overlap])
                    tails.append([chunk * step + e for e in sure if e >= step])
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind)], ["key", "chunk", "heads", "tails"])

        return chunks.mapInArrow(run, "key string, chunk long, heads array<long>, tails array<long>")

    def _pieces(self, seamed: DataFrame) -> DataFrame:
        """key, chunk, ids of what lies between a chunk's two seams."""
        raw, pattern, step = self.raw, self.pattern, self.chunk_chars

        def run(batches):
            words = vocabulary(raw.value, pattern)
            for batch in batches:
                found = []
                for chunk, text, begin, end in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    here = text[begin - chunk * step : None if end is None else end - chunk * step + LOOK_AHEAD]
                    found.append(words.encode(here, None if end is None else end - begin))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ids_column(found)], ["key", "chunk", "ids"])

        return seamed.select("key", "chunk", "text", "begin", "end").mapInArrow(run, "key string, chunk long, ids array<int>")

    def decode(self, encoded: DataFrame, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
        """``encoded`` with a binary column ``into``: the tokens' bytes, concatenated. Null ids give null."""
        raw, pattern = self.raw, self.pattern

        @F.arrow_udf("binary")
        def decoded(ids: pa.Array) -> pa.Array:
            words = vocabulary(raw.value, pattern)
            return pa.array([words.decode(x.values.to_numpy()) if x.is_valid else None for x in ids], pa.binary())

        return encoded.withColumn(into, decoded(F.col(ids_col)))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
