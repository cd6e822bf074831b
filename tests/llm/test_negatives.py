"""Hard negatives against brute force: scores, ties, repeats, nulls, vectors of different lengths, several blocks of anchors."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives
from tidemark.llm.queries import QUERIES, QUERY_ORACLE_SQL


def brute_force(rows, every, low=80, high=100, n=5, m=5):
    rows = [(i, y, tuple(math.floor(256 * v) for v in x)) for i, y, x in rows if y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = set()
    for a, y, q in {r for r in rows if r[0] is not None and r[0] % every == 0}:
        def best(label_fits, score_fits, most):
            found = {(-sum(u * v for u, v in zip(q, p, strict=False)), (i is None, i or 0), i) for i, z, p in rows if i != a and label_fits(z)}
            return [(i, -s) for s, _, i in sorted(found) if score_fits(-s)][:most]

        for p, ps in best(lambda z: z == y, lambda s: True, n):
            for rank, (i, s) in enumerate(best(lambda z: z != y, lambda s: low * ps <= 100 * s <= high * ps, m), 1):
                out.add((a, p, rank, i, ps, s))
    return out


def table(seed=1, n=400, dims=20):
    r = random.Random(seed)
    rows = [(i, r.choice([0, 1, 2, 2, 2]), [r.choice([-0.4, 0.1, 0.25, 0.3, 0.7]) for _ in range(dims - (i % 3 == 0))]) for i in range(n)]
    odd = [(None, 1, [0.1] * dims), (None, 2, [0.2] * dims), (401, None, [0.1] * dims), (402, 1, None), (403, 1, [0.1, None]), (404, 1, [float("nan")] * dims), (405, 2, [float("inf")] * dims), (406, 0, []), (10, 2, [0.3] * dims)]
    return [*rows, *odd, rows[20], rows[21], rows[22], odd[0]]


SCHEMA = "vec_id long, label int, embedding array<double>, q string, anchor string, rank int"


@pytest.mark.parametrize("block", [1 << 18, 500])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", block)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in table()], SCHEMA).repartition(5)
    got = [tuple(r) for r in negatives.mine(negatives.vectors(df), F.col("vec_id") % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(table(), 10)


def test_scores_of_any_size_are_inner_products():
    r = np.random.default_rng(1)
    for span, dims in ((2, 1), (200, 64), (200, 13), (2**20, 9), (2**40, 16)):
        q, a = r.integers(-span, span, (50, dims)), r.integers(-span, span, (7, dims))
        with np.errstate(over="ignore"):
            assert np.array_equal(negatives.scores(negatives.planes(q), negatives.tables(a)).astype(np.int64), q @ a.T)
    assert negatives.scores(negatives.planes(np.zeros((3, 0), np.int64)), negatives.tables(np.zeros((2, 0), np.int64))).tolist() == [[0, 0]] * 3


def test_empty_tables_and_no_anchors(spark):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in table(n=30)], SCHEMA)
    assert negatives.mine(negatives.vectors(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(negatives.vectors(df), F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({QUERY_ORACLE_SQL['op11_hard_negatives']})").fetchall()
    got = QUERIES["op11_hard_negatives"](spark, f"/root/testdata/{sf}")
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(want) and want
