"""Ranked search against brute force: ties, repeats, nulls, pruning that loses nothing, several blocks of queries."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import search
from tidemark.llm.queries import QUERIES, QUERY_ORACLE_SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    split = [(i, terms(t)) for i, t in docs]
    count = sum(bool(w) for _, w in split)
    total = sum(len(w) for _, w in split)
    out = []
    for item, text in items:
        found = []
        for i, words in split:
            score = 0
            for t in terms(text):
                if tf := words.count(t):
                    df = sum(t in w for _, w in split)
                    m = 100 - 75 + (75 * len(words) * count) // total
                    score += math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=2, n=150):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.5)) % 60}" for _ in range(4_000)] + ["Été", "É", "naïve", "x_y", "10"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 4, 30, 120])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " ,.\t"), (n + 3, "ÉTÉ été W1-w2_w3"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, docs[7][1]), (7, docs[7][1]), (n + 4, docs[9][1]), (n + 5, "w5 " * 20_000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 12])))) for i in range(20)]
    return docs, [*items, (20, None), (21, "unknown-term"), (3, "w1 w1 w1 W1 w2"), (None, "w1 w3 été"), (23, docs[9][1])]


@pytest.mark.parametrize("at_once,leaf,tree", [(256, 32, 4_096), (4, 2, 4_096), (256, 3, 20)])
def test_equals_brute_force(spark, monkeypatch, at_once, leaf, tree):
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", at_once)
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "a", 1, 2) for x in docs], "doc_id long, text string, item string, rank int, score long").repartition(3)
    q = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id long")
    got = sorted(map(tuple, search.search(d, q).collect()), key=str)
    assert got == brute_force(docs, items)


def test_pruning_loses_nothing_and_skips_leaves(monkeypatch):
    monkeypatch.setattr(search, "LEAF", 4)
    r = np.random.default_rng(4)
    width, rows = 90, 600
    topic = r.integers(0, 6, rows)
    dense = np.where(r.random((rows, width)) < 0.05, r.integers(1, 10**10, (rows, width)), 0)
    dense[np.arange(width) // 15 != topic[:, None]] = 0
    row, cols = np.nonzero(dense)
    tree = search.Tree(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), cols, dense[row, cols], width)
    queries = np.where(r.random((25, width)) < 0.1, r.integers(1, 3, (25, width)), 0)
    norms = np.sqrt(np.add.reduceat(queries.astype(float) ** 2, np.arange(0, width, search.GROUP), axis=1))
    bounds, ids, exact = tree.upper_bounds(queries.astype(float), norms), np.arange(rows), dense @ queries.T
    leaves = len(tree.bounds) - 1
    for leaf in range(leaves):  # no bound is below what lies under it, up to the root
        below, node = tree.order[tree.bounds[leaf] : tree.bounds[leaf + 1]], tree.first_leaf + leaf
        while True:
            assert (bounds[:, node] >= exact[below].max(axis=0)).all()
            if not node:
                break
            node = (node - 1) // 2
    visited = 0
    for q in range(25):
        best = search.Best(10)
        visited += search.search_tree(tree, bounds[q], queries[q], ids, best)
        want = sorted((-int(s), i) for i, s in enumerate(exact[:, q]) if s > 0)[:10]
        assert best.found == want
    assert visited < 0.7 * 25 * leaves


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(d.limit(0), q).count() == 0 and search.search(d, q.limit(0)).count() == 0
    assert search.search(d.withColumn("text", d["text"].substr(9, 1)), q).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({QUERY_ORACLE_SQL['op12_ranked_search']})").fetchall()
    got = QUERIES["op12_ranked_search"](spark, f"/root/testdata/{sf}")
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and sorted(map(tuple, got.collect())) == sorted(want) and want
