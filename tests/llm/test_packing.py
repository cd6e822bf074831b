"""Packing: every id in one piece, sequences within all limits, ids equal the tokenizer's, no padding where cuts are free."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.packing import Limits

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "a", " \n\n  b\t", "It's we'll ' 'S don't", "x" * 9_000, "Ünïcödé 日本語 😀 ²½Ⅷ \x1c\x85\u00a0 ſ", "end <|endoftext|> of", "1234 5678 --- !!!", "\r\n\r\n word"]


def texts(seed=3, n=300):
    r = random.Random(seed)
    words = ["the", "Straße", "élan", "ñu", "x1", "—", "foo,", "bar.", "\n", "  ", "12", "日本"]
    return [*ODD, *[" ".join(r.choice(words) for _ in range(r.choice([1, 3, 40, 900]))) for _ in range(n)]]


def test_ids_equal_the_tokenizer():
    t, words = Tokenizer.from_file(PATH), packing.piece_ids(open(PATH).read())
    for text in texts():
        assert np.frombuffer(words.encode(text or ""), np.uint32).tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def by_sequence(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append(r)
    for pieces in found.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at and p.length > 0
            at += p.length
    return found


def whole(rows, key="doc_id"):
    """Each key's ids, put together from its pieces."""
    found = defaultdict(dict)
    for r in rows:
        assert r.start not in found[r[key]]
        found[r[key]][r.start] = np.frombuffer(bytes(r.ids), np.uint32).tolist()
    for k, pieces in found.items():
        at = 0
        for start in sorted(pieces):
            assert start == at
            at += len(pieces[start])
        found[k] = [i for start in sorted(pieces) for i in pieces[start]]
    return found


def test_every_id_lies_in_one_piece_and_no_sequence_is_padded(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts())], "doc_id long, text string, ids string, start long").repartition(3)
    rows = packing.pack_texts(docs, PATH).collect()
    t = Tokenizer.from_file(PATH)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for i, x in enumerate(texts())}
    assert whole(rows) == want
    assert all(r.doc_tokens == len(want[r.doc_id]) and r.loss_tokens == r.length for r in rows)
    for pieces in by_sequence(rows).values():
        total = sum(p.length for p in pieces)
        assert total <= 2_048 and total & (total - 1) == 0 and len(pieces) <= Limits.segments
    assert len(by_sequence(rows)) <= sum(map(len, want.values())) / 2_048 + 3 * 12


def test_query_digests_equal_brute_force(spark):
    from tidemark.llm.queries import op13_vector_packing

    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ids = {d.doc_id: np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], np.uint32) for d in docs}
    rows = op13_vector_packing(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    by_sequence(rows)


def test_rows_that_repeat_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (5, None), (5, None)], "doc_id long, text string")
    rows = packing.pack_texts(docs.coalesce(1), PATH).collect()
    assert sum(r.length for r in rows if r.doc_id is None) == 6 and [r.doc_tokens for r in rows if r.doc_id == 5] == [1, 1]
    assert packing.pack_texts(docs.limit(0), PATH).count() == 0


def test_tiny_documents_meet_the_segment_limit(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(2_000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_texts(docs, PATH, Limits(segments=100)).collect()
    assert sum(r.length for r in rows) == 4_000
    for pieces in by_sequence(rows).values():
        total = sum(p.length for p in pieces)
        assert len(pieces) <= 100 and total & (total - 1) == 0


@pytest.mark.parametrize("cut", [False, True])
def test_three_limits_hold_and_the_heuristic_beats_first_come(spark, cut):
    r = random.Random(5)
    limits = Limits(512, 8, 200)
    rows = []
    for i in range(600):
        n = r.choice([5, 20, 60, 200, 700])
        share = r.choice([0.05, 0.3, 0.9])
        rows.append((i, list(range(n)), [r.random() < share for _ in range(n)]))
    rows += [(600, None, None), (601, [], []), (602, [1, 2], None), (603, [1, 2], [None]), (604, [1, 2], [False])]
    examples = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>").coalesce(2)
    got = packing.pack(examples, limits, cut, loss_col="loss").collect()
    assert whole(got) == {i: ids for i, ids, _ in rows if ids}
    loss = {i: [True] * len(ids or []) if b is None else [bool(x) for x in b] + [True] * (len(ids) - len(b)) for i, ids, b in rows}
    found = by_sequence(got)
    for pieces in found.values():
        assert sum(p.length for p in pieces) <= limits.tokens and len(pieces) <= limits.segments
        assert all(p.loss_tokens == sum(loss[p.doc_id][p.start : p.start + p.length]) for p in pieces)
        assert sum(p.loss_tokens for p in pieces) <= limits.loss
    if not cut:
        assert {(p.doc_id, p.start) for p in got if p.length < p.doc_tokens} <= {(i, s) for i, ids, _ in rows if ids and (len(ids) > 512 or sum(loss[i]) > 200) for s in range(len(ids))}
        bins, left = 0, (0, 0, 0)
        for p in sorted(got, key=lambda p: (p.doc_id, p.start)):  # next fit, in order
            need = (p.length, 1, p.loss_tokens)
            if any(a < b for a, b in zip(left, need, strict=True)):
                bins, left = bins + 1, (512, 8, 200)
            left = tuple(a - b for a, b in zip(left, need, strict=True))
        assert len(found) < 0.9 * bins


def test_sequences_are_whole_and_padded(spark):
    docs = spark.createDataFrame([(1, list(range(5))), (2, [7, 8]), (3, [9])], "doc_id long, ids array<int>").coalesce(1)
    row = packing.sequences(packing.pack(docs, Limits(tokens=16), cut=False), 16).collect()
    assert [(r.n_tokens, np.frombuffer(bytes(r.ids), np.uint32).tolist(), r.segments) for r in row] == [(8, [0, 1, 2, 3, 4, 7, 8, 9], [5, 2, 1])]
    short = packing.sequences(packing.pack(docs.where("doc_id < 3"), Limits(tokens=16)), 16).collect()[0]
    assert np.frombuffer(bytes(short.ids), np.uint32).tolist() == [0, 1, 2, 3, 4, 7, 8] + [0] * 9
