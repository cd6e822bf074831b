"""Ranked lexical search: exact top documents by sparse inner product, with ball trees over the documents.

A query's score for a document is the inner product of the query's term counts with the document's term weights (integers, a
saturating function of the occurrences times a term weight). One pass turns whole texts into sparse vectors over the terms that some query
of a block uses (other terms add nothing to any score) and counts the terms of all documents. Tasks then build ball
trees over some thousand documents at a time and search every query in them:

* a tree halves its documents along the line between two far ones until a leaf holds a few; a node has a centroid and, for each group of
  neighbouring terms, a radius that covers its documents' distances to the centroid within that group;
* no document below a node can score more than query . centroid + the sum over groups of |query in the group| * radius (Cauchy-Schwarz in
  each group), rounded upwards by more than doubles can be off;
* subtrees are visited best bound first and dropped once the bound is below the worst of the k best scores so far; leaves are
  scored exactly in 64-bit integers. What may tie with the k-th best is never dropped.

A task keeps the k best of each query over all its trees, so a few rows for each task and query are shuffled and ranked.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.workspace import materialise

#: Queries that are searched in one pass over the documents; their terms are broadcast.
QUERIES_AT_ONCE = 256

#: Documents of a leaf, and the most of a tree.
LEAF, TREE = 32, 4_096

#: Terms that share a radius, and the most numbers in the centroids of a tree and in a block of documents beside them.
GROUP, CELLS, BLOCK = 8, 1 << 22, 1 << 18

#: Upper bounds are raised by this share and one more, so that rounding never makes them too small.
ROUND_UP = 1e-9

#: Rows that a task passes on at once.
ROWS = 2_000

NO_ID = np.iinfo(np.int64).max

# Letters and digits of ASCII and everything beyond it are in terms; A-Z are lower-cased, other bytes end a term.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


def sparse_texts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms in the text), term and tf (arrays): the text's terms that are in ``vocabulary``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get = known.value.get
        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, len(whole), ROWS)):
                lengths, ends, found, times = [], [0], [], []
                for text in batch.column(1):
                    words = terms(text.as_py())
                    counts = Counter(map(get, words))
                    counts.pop(None, None)
                    lengths.append(len(words))
                    found.extend(counts.keys())
                    times.extend(counts.values())
                    ends.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["id", "n", "term", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, term array<int>, tf array<int>")


class Corpus:
    """What scores need from all documents: their number, the mean length and each term's weight."""

    def __init__(self, documents: int, total: int, document_counts: dict[int, int], vocabulary: int):
        self.documents, self.total = documents, total
        counts = [document_counts.get(t, 0) for t in range(vocabulary)]
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in counts], np.int64)

    def values(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The weights of terms in documents of ``n`` terms each: integers, divisions rounding down."""
        m = np.array([100 - 75 + (75 * int(x) * self.documents) // self.total for x in n], np.int64)
        tf = tf.astype(np.int64)
        return self.weights[term] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m[row]))


class Tree:
    """A ball tree over sparse rows (``indptr``, ``cols``, ``values``) in heap order; node i has the children 2i+1 and 2i+2."""

    def __init__(self, indptr: np.ndarray, cols: np.ndarray, values: np.ndarray, width: int):
        rows = len(indptr) - 1
        depth = 0
        while rows >> depth > LEAF and (4 << depth) * max(1, width) <= CELLS:
            depth += 1
        self.first_leaf = (1 << depth) - 1
        order, self.bounds = self._halved(indptr, cols, values, width, depth)
        lengths = np.diff(indptr)[order]
        self.order, self.indptr = order, np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(indptr[:-1][order] - self.indptr[:-1], lengths) + np.arange(self.indptr[-1])
        self.cols, self.values = cols[at], values[at]
        self._balls(width)

    @staticmethod
    def _halved(indptr, cols, values, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of the rows and the leaves' bounds in it; far rows are sought among a few signed sums of each row."""
        signs = np.random.default_rng(1).choice([-1.0, 1.0], (width, 8))
        full = np.flatnonzero(np.diff(indptr))
        points = np.zeros((len(indptr) - 1, 8))
        if len(full):
            points[full] = np.add.reduceat(signs[cols] * values[:, None], indptr[:-1][full], axis=0)
        parts = [np.arange(len(points))]
        for _ in range(depth):
            halves = []
            for part in parts:
                own = points[part]
                far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
                line = own[np.argmax(((own - far) ** 2).sum(axis=1))] - far
                split = np.argsort(own @ line, kind="stable")
                halves += [part[split[: len(part) // 2]], part[split[len(part) // 2 :]]]
            parts = halves
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _balls(self, width: int) -> None:
        nodes, leaves = 2 * self.first_leaf + 1, len(self.bounds) - 1
        starts = np.arange(0, max(1, width), GROUP)
        self.centres, self.radii = np.zeros((nodes, max(1, width))), np.zeros((nodes, len(starts)))
        step = max(1, BLOCK // max(1, width))
        for leaf in range(leaves):
            node, (a, b) = self.first_leaf + leaf, self.bounds[leaf : leaf + 2]
            i, j = self.indptr[a], self.indptr[b]
            np.add.at(self.centres[node], self.cols[i:j], self.values[i:j] / (b - a))
            for at in range(a, b, step):
                upto = min(b, at + step)
                apart = np.repeat(-self.centres[node][None], upto - at, axis=0)
                p, q = self.indptr[at], self.indptr[upto]
                apart[np.repeat(np.arange(upto - at), np.diff(self.indptr[at : upto + 1])), self.cols[p:q]] += self.values[p:q]
                squares = np.add.reduceat(apart * apart, starts, axis=1).max(axis=0)
                self.radii[node] = np.maximum(self.radii[node], np.sqrt(squares))
        for node in range(self.first_leaf - 1, -1, -1):
            pair = slice(2 * node + 1, 2 * node + 3)
            self.centres[node] = self.centres[pair].mean(axis=0)
            away = np.sqrt(np.add.reduceat((self.centres[pair] - self.centres[node]) ** 2, starts, axis=1))
            self.radii[node] = (away + self.radii[pair]).max(axis=0) * (1 + ROUND_UP)

    def upper_bounds(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The most that a row below each node can score (queries x nodes)."""
        return (queries @ self.centres.T + norms @ self.radii.T) * (1 + ROUND_UP) + 1

    def leaf_scores(self, node: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a leaf and their exact scores, of those that share a term with the query."""
        a, b = self.bounds[node - self.first_leaf : node - self.first_leaf + 2]
        i, j = self.indptr[a], self.indptr[b]
        sums = np.concatenate([[0], np.cumsum(counts[self.cols[i:j]] * self.values[i:j])])
        scores = sums[self.indptr[a + 1 : b + 1] - i] - sums[self.indptr[a:b] - i]
        some = np.flatnonzero(scores)
        return self.order[a:b][some], scores[some]


class Best:
    """The ``k`` best (score, id) of one query: higher scores first, then smaller ids; repeated ids count each."""

    def __init__(self, k: int):
        self.k, self.found, self.worst = k, [], 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.worst
        if some.any():
            self.found = sorted([*self.found, *zip((-scores[some]).tolist(), ids[some].tolist(), strict=True)])[: self.k]
            if len(self.found) == self.k:
                self.worst = -self.found[-1][0]


def search_tree(tree: Tree, bounds: np.ndarray, counts: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Best-first search of one query; returns the leaves that it scored."""
    queue, visited = [(-bounds[0], 0)], 0
    while queue and -queue[0][0] >= best.worst:
        _, node = heapq.heappop(queue)
        if node >= tree.first_leaf:
            rows, scores = tree.leaf_scores(node, counts)
            best.add(scores, ids[rows])
            visited += 1
        else:
            for child in (2 * node + 1, 2 * node + 2):
                if bounds[child] >= best.worst:
                    heapq.heappush(queue, (-bounds[child], child))
    return visited


class Queries:
    """A block of queries: their keys, term counts (queries x terms) and norms in each group of terms."""

    def __init__(self, items: list[Row]):
        found = [Counter(terms(r["text"])) for r in items]
        self.keys = [r["query"] for r in items]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for c in found for t in c}))}
        self.counts = [{self.vocabulary[t]: c for t, c in own.items()} for own in found]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        width = max(1, len(self.vocabulary))
        counts = np.zeros((len(self.counts), width), np.int64)
        for row, own in zip(counts, self.counts, strict=True):
            row[list(own)] = list(own.values())
        return counts, np.sqrt(np.add.reduceat(counts.astype(float) ** 2, np.arange(0, width, GROUP), axis=1))


def _search(batches: Iterator[pa.RecordBatch], queries: Queries, corpus: Corpus, k: int) -> Iterator[pa.RecordBatch]:
    counts, norms = queries.arrays()
    real, width = counts.astype(float), len(queries.vocabulary)
    best = [Best(k) for _ in queries.keys]
    for whole in batches:
        for batch in (whole.slice(at, TREE) for at in range(0, len(whole), TREE)):
            ids, n = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy()
            lengths, cols, tf = batch.column(2).value_lengths().to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            if not len(cols):
                continue
            values = corpus.values(n, np.repeat(np.arange(len(n)), lengths), cols, tf)
            tree = Tree(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), cols, values, width)
            bounds = tree.upper_bounds(real, norms)
            for q in np.flatnonzero(bounds[:, 0] >= [b.worst for b in best]):
                search_tree(tree, bounds[q], counts[q], ids, best[q])
    rows = [(key, None if i == NO_ID else i, -s) for key, b in zip(queries.keys, best, strict=True) for s, i in b.found]
    for at in range(0, len(rows), ROWS):
        columns = list(zip(*rows[at : at + ROWS], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_col``, rank (from 1), ``id_col``, score.

    Equal scores come by ascending id, null ids last; only scores above 0 count, so an item may have fewer. Null and blank texts have no
    terms. Rows of documents that repeat an id are documents of their own; rows of items that repeat an id are searched each.
    Other columns are ignored. An empty table on either side gives no rows.
    """
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).withColumn("query", F.monotonically_increasing_id())
    items = materialise(items, "items")
    blocks = max(1, -(-items.count() // QUERIES_AT_ONCE))
    out = None
    for number in range(blocks):
        found = _search_block(docs, items.where(F.pmod("query", F.lit(blocks)) == number), k, id_col, text_col)
        found = materialise(found, "found") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    named = out.join(items.select("query", "item"), "query")
    return named.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    queries = Queries(items.collect())
    vectors = materialise(sparse_texts(docs, queries.vocabulary, id_col, text_col), "vectors")
    documents, total = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = vectors.select(F.explode("term").alias("term")).groupBy("term").count()
    shared = spark.sparkContext.broadcast((queries, Corpus(documents, total, dict(map(tuple, counted.collect())), len(queries.vocabulary))))
    found = vectors.mapInArrow(lambda batches: _search(batches, *shared.value, k), "query long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
