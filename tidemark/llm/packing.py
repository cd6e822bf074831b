"""Packing examples into training sequences: vector bin packing under several limits at once.

An example is a row of token ids, some of which bear loss. A sequence has three limits: tokens, segments (pieces of examples)
and loss-bearing tokens. Every task packs the rows of its own partition as they stream by, so nothing is shuffled: pieces as long
as a sequence become sequences at once, and what remains of each example waits in a pool of bounded size. A sequence is
filled from the pool by the dot-product heuristic: of the pieces that still fit, it takes the one whose demand (a vector with a
share of each limit) has the largest weighted dot product with what the sequence has left; a limit's weight is the pool's
mean demand for it. So short pieces are spent where tokens are scarce, and pieces with little loss where loss is.

With ``cut``, the best piece that does not fit is cut to fill the rest. A sequence that meets another limit first, or the last
of a task, is then cut back to a power of two, a length that needs no padding, and the excess goes back to the pool.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

#: Pieces that wait in a task before sequences are filled from them; half of them stay to choose from.
POOL = 512

#: Pre-tokens whose ids a worker remembers before it starts afresh, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64

#: Pieces that a task passes on at once.
ROWS = 1_000

#: The id that ends a document.
END_ID = 1

# How the vocabulary file's pre-tokeniser splits text, in any text and in text of ASCII and Latin letters only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN_PATTERN = rf" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most."""

    tokens: int = 2_048
    segments: int = 256
    loss: int = 2_048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("each limit must be positive")


class PieceIds(dict):
    """Maps a pre-token to its ids as bytes of uint32, for the byte-level BPE in a ``tokenizers`` file (its JSON as text).

    Ids are those of the file's own tokenizer without added special tokens: pre-tokens of a BPE are merged independently, so
    each distinct one is merged once. Texts that contain a special token's own string are passed to the tokenizer whole.
    """

    def __init__(self, raw: str):
        found = json.loads(raw)
        special = [t["content"] for t in found["added_tokens"]]
        self.raw, self.tokenizer = raw, None
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        names = {c: bytes((b,)) for b, c in zip(*byte_names(), strict=True)}
        ranks = {b"".join(names[c] for c in t): i for t, i in found["model"]["vocab"].items() if t not in special}
        self.merge = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.any, self.latin, self.other = regex.compile(PATTERN), re.compile(LATIN_PATTERN, re.A), re.compile(rf"[^\x00-\x7f{LATIN}]")

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.merge(piece), np.uint32).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.special.search(text):
            self.tokenizer = self.tokenizer or Tokenizer.from_str(self.raw)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        split = self.any if self.other.search(text) else self.latin
        return b"".join(map(self.__getitem__, split.findall(text)))


def byte_names() -> tuple[list[int], list[str]]:
    """Bytes and the characters that stand for them in a byte-level vocabulary: visible Latin-1 stands for itself, the rest follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return visible + rest, [chr(b) for b in visible] + [chr(256 + i) for i in range(len(rest))]


@lru_cache(maxsize=2)
def piece_ids(raw: str) -> PieceIds:
    return PieceIds(raw)


class Example:
    """Ids (uint32) of one row, which of them bear loss (None: all), and the row's own key."""

    __slots__ = ("key", "ids", "before")

    def __init__(self, key, ids: np.ndarray, loss: np.ndarray | None):
        self.key, self.ids = key, ids
        self.before = None if loss is None else np.concatenate([[0], np.cumsum(loss)])  # loss-bearing ids before each place

    def loss(self, start: int, end: int) -> int:
        return end - start if self.before is None else int(self.before[end] - self.before[start])

    def upto(self, start: int, tokens: int, loss: int) -> int:
        """Where the longest piece ends that begins at ``start`` and has at most so many tokens and loss-bearing ones."""
        end = min(len(self.ids), start + tokens)
        if self.before is None:
            return min(end, start + loss)
        return min(end, int(np.searchsorted(self.before, self.before[start] + loss, side="right")) - 1)


Piece = tuple[Example, int, int]


class Packer:
    """Fills sequences with pieces of the examples it is given; each finished sequence is a list of (example, start, end)."""

    def __init__(self, limits: Limits, cut: bool, pool: int = POOL):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.pieces: list[Piece] = []
        self.demand = np.empty((0, 3))
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, example: Example) -> Iterator[list[Piece]]:
        """Take an example; yields the sequences that are then full. What exceeds a sequence by itself is cut in any case."""
        at, n = 0, len(example.ids)
        while at < n:
            end = example.upto(at, self.limits.tokens, self.limits.loss)
            if end - at == self.limits.tokens:
                yield [(example, at, end)]
            else:
                self.pieces.append((example, at, end))
            at = end
        if len(self.pieces) >= self.pool:
            yield from self.fill(self.pool // 2)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self.fill(0)

    def fill(self, leave: int) -> Iterator[list[Piece]]:
        """Fill sequences until at most ``leave`` pieces wait."""
        while len(self.pieces) > leave:
            self.demand = np.array([(e - s, 1, x.loss(s, e)) for x, s, e in self.pieces], float) / self.caps
            weights, waiting = self.demand.mean(axis=0), np.ones(len(self.pieces), bool)
            rest: list[Piece] = []
            left = len(self.pieces)
            while left and left + len(rest) > leave:
                sequence, taken = self._one(weights, waiting, rest)
                left -= taken
                yield sequence
            self.pieces = [p for p, w in zip(self.pieces, waiting, strict=True) if w] + rest

    def _one(self, weights: np.ndarray, waiting: np.ndarray, rest: list[Piece]) -> tuple[list[Piece], int]:
        """One sequence from what waits, and how many it took; what is cut off goes to ``rest``."""
        room, sequence = np.ones(3), []
        before = np.count_nonzero(waiting)
        while waiting.any() and room.min() > 1e-9:
            fits = waiting & (self.demand <= room + 1e-9).all(axis=1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, self.demand @ (weights * room), -1.0)))
            waiting[best] = False
            sequence.append(self.pieces[best])
            room = room - self.demand[best]
        tokens, segments, loss = (round(r * c) for r, c in zip(room, self.caps, strict=True))
        if self.cut and waiting.any() and min(tokens, segments, loss) > 0:
            best = int(np.argmax(np.where(waiting, self.demand @ (weights * room), -1.0)))
            example, start, end = self.pieces[best]
            upto = example.upto(start, tokens, loss)
            waiting[best] = False
            sequence.append((example, start, upto))
            rest.append((example, upto, end))
        if self.cut:
            self._even(sequence, rest)
        return sequence, before - np.count_nonzero(waiting)

    def _even(self, sequence: list[Piece], rest: list[Piece]) -> None:
        """Cut a sequence that is not full back to a power of two; the last pieces' ends go to ``rest``."""
        total = sum(e - s for _, s, e in sequence)
        if total == self.limits.tokens:
            return
        excess = total - (1 << (total.bit_length() - 1))
        while excess:
            example, start, end = sequence.pop()
            kept = max(start, end - excess)
            excess -= end - kept
            rest.append((example, kept, end))
            if kept > start:
                sequence.append((example, start, kept))


OUT = "start long, length long, loss_tokens long, doc_tokens long, sequence_id long, offset long, ids binary"


def _rows(sequences: Iterable[list[Piece]], key: pa.Field) -> Iterator[pa.RecordBatch]:
    """The pieces as rows; a sequence's id has the task's partition in its upper bits, so that it is the same if the task is repeated."""
    first = TaskContext.get().partitionId() << 33
    columns: list[list] = [[] for _ in range(8)]

    def batch() -> pa.RecordBatch:
        kinds = [key.type, *[pa.int64()] * 6, pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key.name, "start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset", "ids"])
        for c in columns:
            c.clear()
        return out

    for number, sequence in enumerate(sequences):
        offset = 0
        for x, start, end in sequence:
            for c, v in zip(columns, (x.key, start, end - start, x.loss(start, end), len(x.ids), first + number, offset, x.ids[start:end].tobytes()), strict=True):
                c.append(v)
            offset += end - start
        if len(columns[0]) >= ROWS:
            yield batch()
    if columns[0]:
        yield batch()


def _packed(examples: Iterable[Example], limits: Limits, cut: bool, key: pa.Field) -> Iterator[pa.RecordBatch]:
    def sequences():
        packer = Packer(limits, cut)
        for example in examples:
            yield from packer.add(example)
        yield from packer.finish()

    return _rows(sequences(), key)


def _schema(df: DataFrame, key: str) -> str:
    return StructType([df.schema[key]]).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ", 1) + ", " + OUT


def pack_texts(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts, encoded by the ``tokenizers`` file and ended by ``END_ID``, cut and packed; every id bears loss.

    One row for each piece: ``id_col``, start, length, loss_tokens, doc_tokens, sequence_id, offset, ids (uint32, little-endian).
    A null text is an empty one: its only id is the end. Rows that repeat an id are packed one by one; null ids stay null; other
    columns are ignored. An empty table gives no rows. The driver reads the file and broadcasts it.
    """
    raw = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())
    end = np.array([END_ID], np.uint32).tobytes()

    def run(batches):
        key: list[pa.Field] = []

        def examples():
            words = piece_ids(raw.value)
            for batch in batches:
                for i, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = words.encode(text.as_py() or "") + end
                    yield Example(i.as_py(), np.frombuffer(ids, np.uint32), None)

        head = next(batches := iter(batches), None)
        if head is not None:
            batches = _chain(head, batches)
            yield from _packed(examples(), limits, True, head.schema.field(0))

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _schema(rows, id_col))


def _chain(head, rest):
    yield head
    yield from rest


def pack(examples: DataFrame, limits: Limits = Limits(), cut: bool = False, id_col: str = "doc_id", ids_col: str = "ids", loss_col: str | None = None) -> DataFrame:
    """Examples with an array of ids, and optionally one of booleans (which ids bear loss), packed; rows as of ``pack_texts``.

    Without ``cut`` an example is split only where it exceeds a limit by itself, and sequences may be short of their limits. A null
    or empty array has no ids and no rows. Of a loss array that is null or short the missing entries bear loss, null entries
    do not. Rows that repeat are packed one by one.
    """
    columns = [F.col(id_col).alias(id_col), F.col(ids_col).alias("ids"), (F.lit(None).cast("array<boolean>") if loss_col is None else F.col(loss_col)).alias("loss")]

    def run(batches):
        def examples():
            for batch in batches:
                for i, ids, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if ids:
                        bears = None if loss is None else np.array([bool(v) for v in loss[: len(ids)]] + [True] * (len(ids) - len(loss)), bool)
                        yield Example(i, np.array(ids, np.uint32), bears)

        head = next(batches := iter(batches), None)
        if head is not None:
            batches = _chain(head, batches)
            yield from _packed(examples(), limits, cut, head.schema.field(0))

    rows = examples.select(columns)
    return rows.mapInArrow(run, _schema(rows, id_col))


def sequences(packed: DataFrame, tokens: int = Limits.tokens) -> DataFrame:
    """sequence_id, n_tokens, segments (the pieces' lengths, in order), ids (binary, padded with id 0 to ``tokens`` unless a power of two)."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), pieces.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    even = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padded = F.when(even, joined).otherwise(F.rpad(joined, F.lit(4 * tokens), F.lit(b"\0")))
    return whole.select("sequence_id", "n_tokens", F.col("p.length").alias("segments"), padded.alias("ids"))


def ids_crc32(ids: Column) -> Column:
    """CRC-32 of ids stored as little-endian uint32, unsigned."""
    return F.crc32(ids)
