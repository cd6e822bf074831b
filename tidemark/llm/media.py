"""A media column over a deduplicated store of content-defined chunks.

A payload is stored as a WAV file with one 8-bit sample for each byte. The samples of every file are cut where a rolling gear
hash of the last 32 bytes has its top bits zero, so that equal passages give equal chunks wherever they stand. A file is its
header and the ordered list of its chunks' digests (SHA-256). The store has each distinct chunk once: those that several
places name under their digest, those that one place names in the pack of its file, compressed together. Reading joins the
lists with the store, verifies every file's digest and computes features from the samples read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches
from tidemark.workspace import materialise

UNIT, RATE = 64, 8_000

#: Bytes of a chunk at least (but for the last one of a file) and at most, and zero bits at a cut: 1,300 bytes on average.
LEAST, MOST, CUT_BITS = 256, 8_192, 10

#: Short digests of repeated chunks, 8 bytes each, that are broadcast at most; beyond, no file has a pack of its own chunks.
REPEATED = 1_000_000

#: Digests that a task remembers in order not to pass on a repeated chunk twice, and rows of a batch that it returns.
REMEMBERED, ROWS = 100_000, 500

#: The gear table: 256 numbers of 32 bits, made by a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes((b,)), 2024) for b in range(256)], np.uint32)

BLOCK, WINDOW = 1 << 20, 32


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 with zero bytes up to a positive multiple of UNIT, length without them)."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def as_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def gear_cuts(data: bytes) -> np.ndarray:
    """Where the gear hash of the WINDOW bytes before a place has its CUT_BITS top bits zero, in rising order."""
    raw, found = np.frombuffer(data, np.uint8), []
    for begin in range(0, len(raw), BLOCK):
        before = min(begin, WINDOW - 1)
        h = GEAR[raw[begin - before : begin + BLOCK]]
        for step in (1, 2, 4, 8, 16):
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step)
            h = longer
        places = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) - before
        found.append(places[places >= 0] + begin + 1)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunks_of(data: bytes) -> list[bytes]:
    """Cut at the first gear cut at least LEAST and at most MOST bytes after the last one, else after MOST."""
    cuts, out, at = gear_cuts(data), [], 0
    while at < len(data):
        k = np.searchsorted(cuts, at + LEAST)
        end = min(int(cuts[k]) if k < len(cuts) else len(data), at + MOST, len(data))
        out.append(data[at:end])
        at = end
    return out


def features(payload: bytes) -> str:
    """Exact sums over the samples (128 is silence), so that equal payloads give equal strings anywhere."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};sum={x.sum()};energy={(x * x).sum()};peak={abs(x).max()};crossings={crossings}"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def file_of(text: str | None) -> tuple[int, bytes, bytes, list[bytes]]:
    """(length of the text in bytes, digest of its file, header of the file, chunks of its samples)."""
    payload, n = payload_of(text)
    data = as_wav(payload)
    return n, hashlib.sha256(data).digest(), data[: len(data) - len(payload)], chunks_of(payload)


def manifests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (SHA-256 of the WAV file), chunks (digests in order) for each row of ``docs``."""

    def run(batches):
        names = ["doc_id", "n_bytes", "media", "chunks"]
        for batch in batches:
            sizes, files, lists = [], [], []
            for text in batch.column(1):
                n, media, _, parts = file_of(text.as_py())
                sizes.append(n)
                files.append(media)
                lists.append([hashlib.sha256(c).digest() for c in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names)

    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary, chunks array<binary>")


def _short(digest: str) -> Column:
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def _repeated(listed: DataFrame) -> np.ndarray | None:
    """Sorted short digests of the chunks that ``listed`` names more than once; None if there are more than REPEATED."""
    named = listed.select(F.explode("chunks").alias("digest")).groupBy("digest").count()
    repeated = materialise(named.where("count > 1").select(_short("digest").alias("short")).distinct(), "repeated-chunks")
    if repeated.count() > REPEATED:
        return None
    return np.sort(np.array([r["short"] for r in repeated.toLocalIterator()], np.int64))


def chunk_store(docs: DataFrame, listed: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(packs, shared), written to the shared folder; each distinct chunk of the files of ``docs`` is in one of them, once.

    shared: digest, data of the chunks that ``listed``, the manifests, name more than once. packs: media, head, chunks of each
    file, with the places, sizes and bytes (data) of those of its chunks that no other place names. Packs are written where
    they are made; only shared chunks are shuffled. Data are compressed by Zstandard. A file that has equals has no
    chunk of its own, so its packs, one from each row, are alike and hold no bytes.
    """
    repeated = docs.sparkSession.sparkContext.broadcast(_repeated(listed))
    fields = {"media": pa.binary(), "head": pa.binary(), "chunks": pa.list_(pa.binary()), "places": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32()), "digest": pa.binary(), "data": pa.binary()}

    def run(batches):
        pack, passed_on = zstandard.ZstdCompressor(level=3).compress, set()

        def rows_of(files):
            rows = []
            digests = [[hashlib.sha256(c).digest() for c in parts] for *_, parts in files]
            shorts = np.array([int.from_bytes(d[:8]) >> 4 for ds in digests for d in ds], np.int64)
            several = iter((np.ones(len(shorts), bool) if repeated.value is None else np.isin(shorts, repeated.value)).tolist())
            for (_, media, head, parts), ds in zip(files, digests, strict=True):
                own = []
                for place, (digest, chunk) in enumerate(zip(ds, parts, strict=True)):
                    if not next(several):
                        own.append(place)
                    elif digest not in passed_on:
                        passed_on.add(digest)
                        rows.append((None, None, None, None, None, digest, pack(chunk)))
                rows.append((media, head, ds, own, [len(parts[p]) for p in own], None, pack(b"".join(parts[p] for p in own))))
            if len(passed_on) > REMEMBERED:
                passed_on.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], list(fields))

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                yield rows_of([file_of(text.as_py()) for text in batch.column(0).slice(at, ROWS)])

    schema = "media binary, head binary, chunks array<binary>, places array<int>, sizes array<int>, digest binary, data binary"
    made = materialise(docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema), "chunks-made")
    shared = made.where("digest is not null").groupBy("digest").agg(F.first("data").alias("data"))
    return made.where("media is not null").drop("digest"), materialise(shared, "chunk-store")


def _read(media: bytes, want: bytes) -> tuple:
    if hashlib.sha256(media).digest() != want:
        raise ValueError(f"stored media do not match their digest {want.hex()}")
    payload = from_wav(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), want.hex(), features(payload)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """media and the columns of READ for each distinct file of ``packs``, from the stored bytes; a mismatch is an error.

    A file whose chunks are all its own is read where its pack lies; only the others are brought together with shared chunks.
    """
    fields = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["media", *(x.split()[0] for x in READ.split(", "))]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                found = []
                for media, head, places, sizes, data, others in zip(*batch.slice(at, ROWS).columns, strict=True):
                    own, parts, start = unpack(data.as_py()), {}, 0
                    for place, size in zip(places.as_py(), sizes.as_py(), strict=True):
                        parts[place] = own[start : start + size]
                        start += size
                    parts |= {o["place"]: unpack(o["data"]) for o in others.as_py()}
                    whole = head.as_py() + b"".join(parts[p] for p in sorted(parts))
                    found.append((media.as_py(), *_read(whole, media.as_py())))
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names)

    kept = ["media", "head", "places", "sizes", "data"]
    none = F.array().cast("array<struct<place:int,data:binary>>").alias("others")
    whole = F.size("places") == F.size("chunks")
    alone = packs.where(whole).select(*kept, none)
    mixed = packs.where(~whole)
    wanted = mixed.select("media", "chunks", "places").dropDuplicates(["media"]).select("media", "places", F.posexplode("chunks").alias("place", "digest"))
    brought = wanted.where(~F.array_contains("places", F.col("place"))).join(shared, "digest")
    others = brought.groupBy("media").agg(F.collect_list(F.struct("place", "data")).alias("others"))
    joined = mixed.select(kept).dropDuplicates(["media"]).join(others, "media").select(*kept, "others")
    return alone.unionByName(joined).mapInArrow(run, f"media binary, {READ}")


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes and the columns of READ, as read back from the store.

    Null text counts as empty (one unit of zero bytes). Equal texts share one file; repeated rows and null ids are each
    returned. Other columns are ignored; an empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession):
        listed = materialise(manifests(docs, id_col, text_col), "manifests")
        read = materialise(read_media(*chunk_store(docs, listed, text_col)), "media-read")
    return listed.select("doc_id", "n_bytes", "media").join(read, "media").drop("media")
