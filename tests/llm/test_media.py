import hashlib
import io
import random
import wave
import zlib

import pytest

from tidemark.llm import media

from .test_dedup_mix_bpe import docs


def texts():
    r = random.Random(5)
    shared = "".join(r.choice("abcdefgh \n") for _ in range(60_000))
    long = ["".join(r.choice("xyz é\n") for _ in range(k)) + shared + str(k) for k in (3, 700, 5_000)]
    return [None, "", "x", "a" * 64, "é" * 33, *long, "ab" * 100_000, *long[:1]]


def test_chunks_are_content_defined_and_complete():
    r = random.Random(1)
    data = r.randbytes(3_000_000)
    parts, moved = media.chunks_of(data), media.chunks_of(r.randbytes(1_000) + data)
    assert b"".join(parts) == data
    assert all(media.LEAST <= len(c) <= media.MOST for c in parts[:-1])
    assert len(set(parts) & set(moved)) > 0.8 * len(parts)
    h, cuts = 0, []
    for i, b in enumerate(data[:200_000]):
        h = (h << 1) + int(media.GEAR[b]) & 0xFFFFFFFF
        if h >> (32 - media.CUT_BITS) == 0:
            cuts.append(i + 1)
    assert media.gear_cuts(data[:200_000]).tolist() == cuts


@pytest.mark.parametrize("repeated", [1_000_000, 0])
def test_media_round_trip(spark, monkeypatch, repeated):
    monkeypatch.setattr(media, "REPEATED", repeated)
    rows = [(i, t, "s") for i, t in enumerate(texts())] + [(None, "x", None), (2, "x", "s")]
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(payload)
        data = out.getvalue()
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), media.features(payload)))
    got = media.store_and_read(docs(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert media.store_and_read(docs(spark, [])).count() == 0


def test_store_has_each_chunk_once(spark):
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts())])
    listed = media.manifests(table)
    packs, shared = media.chunk_store(table, listed)
    stored = [bytes(x.digest) for x in shared.collect()]
    stored += [bytes(x.chunks[p]) for x in packs.collect() for p in x.places]
    assert len(set(stored)) == len(stored)
    named = {bytes(d) for x in listed.collect() for d in x.chunks}
    assert set(stored) == named
    assert sum(len(x.chunks) for x in listed.collect()) > len(named)


def test_texts_with_a_common_passage_share_stored_chunks(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(2_000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(1_500)
    rows = [f"{prose(200)} {passage}", f"{passage} {prose(90)}", f"{prose(31)} {passage} {prose(7)}", prose(1_500)]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(rows)])
    packs, shared = media.chunk_store(table, media.manifests(table))
    assert shared.count() > 0.7 * len(media.chunks_of(passage.encode()))
    own = {bytes(x.media): sum(x.sizes) for x in packs.collect()}
    for text in rows[:3]:
        raw = media.payload_of(text)[0]
        assert own[hashlib.sha256(media.as_wav(raw)).digest()] < len(raw) - 0.7 * len(passage)
    raw = media.payload_of(rows[3])[0]
    assert own[hashlib.sha256(media.as_wav(raw)).digest()] == len(raw)
