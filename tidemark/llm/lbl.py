"""Language-model scoring with a log-bilinear model (Mnih and Hinton, 2007) trained by noise-contrastive estimation.

The vectors of the last CONTEXT tokens, each weighted by the place it stands in, add up to a prediction of the next token's
vector. The HEAD most frequent tokens have vectors of their own; each other token has that of its ending (its last bytes,
hashed into ENDINGS classes), inside which it takes its add-one unigram share. Classes lie in groups of WIDE, and
p(class | context) = p(group | context) p(class | group, context), two softmaxes over products with the prediction, so that
normalising costs the root of the vocabulary. Training goes in ROUNDS over disjoint slices of the training documents, so that each
token is seen once: in a round every Spark task trains the model of the round before on all tokens of its part of the slice, in
batches with noise drawn for each, and the tasks' vectors and step sizes are averaged, weighted by how often they occurred.
Scores are matrix products over batches of tokens.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.langid import held_out
from tidemark.workspace import materialise

#: Tokens with vectors of their own, classes of endings and the bytes of one, classes in a group.
HEAD, ENDINGS, ENDING, WIDE = 4_000, 96, 3, 64

#: Tokens of context, length of a vector, noise samples (drawn for each softmax of a batch; with 8, biases drift), tokens in a
#: batch (at least; at most twice as many), size of Adagrad's steps.
CONTEXT, WIDTH, NOISE, BATCH, RATE, SEED = 3, 16, 24, 16_384, 0.1, 11

#: Tokens whose softmax is taken at once, so that it stays in a core's cache.
AT_ONCE = 2_048

#: Averages of the tasks' models: each starts from the one before, so that tasks do not drift apart, however many they are.
ROUNDS = 8

#: Counts of at most so many frequent tokens, none longer than LONGEST bytes, are sent to every task; all others are joined.
FREQUENT, LONGEST = 100_000, 64

#: Distinct words that a task counts before it passes them on.
WORDS_HELD = 200_000

#: The end of a text as a token. No word is white space.
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """The words of ``text`` with A-Z lower-cased, then the end."""
    return [*(text or "").encode().lower().split(), END]


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """token (binary), n over all rows; tasks count first, so only their distinct tokens are shuffled."""

    def count(batches):
        held: Counter = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["token", "n"])
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > WORDS_HELD:
                    yield flush()
        yield flush()

    return texts.select(F.col(text_col).alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent_tokens(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """At most ``most`` (token, n), every token above some count, by falling count; the end is always the first.

    The bar is found from a histogram of counts in steps of an eighth of a doubling; the step that it lies in is divided
    further by the tokens' hash, so that many equal counts do not empty the list.
    """
    step, part = F.floor(F.log2(F.col("n").cast("double")) * 8), F.crc32("token") % 1_000
    short = counts.where((F.octet_length("token") <= LONGEST) & (F.col("token") != F.lit(END)))
    taken, total, lowest = F.lit(False), 0, None
    for level, n in sorted(short.groupBy(step.alias("level")).count().collect(), reverse=True):
        if total + n > most:
            bound = 0
            for k, m in sorted(short.where(step == level).groupBy(part.alias("part")).count().collect()):
                total += m
                if total > most:
                    break
                bound = k + 1
            taken = (step == level) & (part < bound)
            break
        total, lowest = total + n, level
    if lowest is not None:
        taken |= step >= lowest
    chosen = [(bytes(r["token"]), r["n"]) for r in short.where(taken).collect()]
    ends = counts.where(F.col("token") == F.lit(END)).first()
    return [(END, ends["n"] if ends else 0), *sorted(chosen, key=lambda r: (-r[1], r[0]))]


def ending(token: bytes) -> int:
    return zlib.crc32(token[-ENDING:]) % ENDINGS


class Classes(dict):
    """token -> class: the number of a token of the head, else the head's size and the token's ending."""

    def __missing__(self, token: bytes) -> int:
        return self.head + ending(token)

    def __init__(self, head: Iterable[bytes]):
        super().__init__((t, i) for i, t in enumerate(head))
        self.head = len(self)


def windows(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(classes of all tokens of ``texts``, the CONTEXT classes before each, the nearest first); ends stand before a text."""
    lengths = np.array([len(text) + CONTEXT for text in texts])
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(int(lengths.sum()), bool)
    for k in range(CONTEXT):
        inside[starts + k] = False
    at = np.flatnonzero(inside)
    flat = np.zeros(len(inside), np.int16)
    flat[at] = np.concatenate([np.asarray(text, np.int16) for text in texts])
    return flat[at], np.stack([flat[at - k] for k in range(1, CONTEXT + 1)])


@dataclass
class Net:
    """before: vectors of context classes; after, bias: of predicted classes; group, group_bias; place: weights of places."""

    before: np.ndarray
    after: np.ndarray
    bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    place: np.ndarray
    often: np.ndarray

    @staticmethod
    def fresh(often: np.ndarray, width: int = WIDTH, seed: int = SEED) -> Net:
        """Small random vectors; biases and noise are the unigram frequencies of classes that occur ``often``, add one."""
        rng, groups = np.random.default_rng(seed), -(-len(often) // WIDE)
        often = often + 1.0
        of_group = np.add.reduceat(often, np.arange(0, len(often), WIDE))
        biases = np.log(often / np.repeat(of_group, WIDE)[: len(often)]), np.log(of_group / of_group.sum())
        vectors = (rng.normal(0, 0.1, (n, width)).astype(np.float32) for n in (len(often), len(often), groups))
        before, after, group = vectors
        return Net(before, after, biases[0].astype(np.float32), group, biases[1].astype(np.float32), np.ones((CONTEXT, width), np.float32), often)

    def params(self) -> list[np.ndarray]:
        return [self.before, self.after, self.bias, self.group, self.group_bias, self.place]

    def predictions(self, before: np.ndarray) -> np.ndarray:
        weighted = [self.before * w for w in self.place]
        ahead = weighted[0].take(before[0], axis=0)
        for vectors, b in zip(weighted[1:], before[1:], strict=True):
            ahead += vectors.take(b, axis=0)
        return ahead

    def log10_p(self, classes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised log10 p of each class given those before it."""
        order, found, starts = _runs(classes // WIDE)
        classes, ahead = classes[order], np.ascontiguousarray(self.predictions(before[:, order]).T)
        of, logs = classes // WIDE, np.empty(len(order))
        for at in range(0, len(order), AT_ONCE):
            rows = slice(at, at + AT_ONCE)
            logs[rows] = _log_softmax_at(self.group @ ahead[:, rows] + self.group_bias[:, None], of[rows])
        for g, rows in zip(found.tolist(), _slices(starts, len(order)), strict=True):
            part = slice(g * WIDE, (g + 1) * WIDE)
            logs[rows] += _log_softmax_at(self.after[part] @ ahead[:, rows] + self.bias[part, None], classes[rows] - g * WIDE)
        out = np.empty(len(order))
        out[order] = logs
        return out / math.log(10)


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each column of ``logits`` the log of the softmax at row ``at``."""
    logits -= logits.max(axis=0)
    chosen = logits[at, np.arange(len(at))]
    return chosen - np.log(np.exp(logits, out=logits).sum(axis=0))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts small integers, the distinct ones, where each begins in that order)."""
    n = np.bincount(keys)
    found = np.flatnonzero(n)
    return np.argsort(keys, kind="stable"), found, (np.cumsum(n) - n)[found]


def _slices(starts: np.ndarray, n: int) -> list[slice]:
    return [slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True)]


def _nce(ahead, target, vectors, bias, chance, parts, drawn):
    """Gradients of the NCE objective by (ahead, vectors, bias): real targets, in ascending order, against classes ``drawn`` by ``chance``
    for each of ``parts`` (slices of the rows)."""
    offset = (bias - np.log(drawn.shape[1] * chance)).astype(np.float32)
    real, false = vectors.take(target, axis=0), vectors[drawn]
    up = 1 / (1 + np.exp(np.einsum("ij,ij->i", ahead, real) + offset[target]))
    down = np.empty((len(target), drawn.shape[1]), np.float32)
    for rows, vs, o in zip(parts, false, offset[drawn], strict=True):
        np.subtract(ahead[rows] @ -vs.T, o, out=down[rows])
    np.exp(down, out=down)
    down += 1
    np.divide(-1, down, out=down)
    back = up[:, None] * real
    by_vectors, by_bias = np.zeros_like(vectors), np.zeros_like(bias)
    _, found, starts = _runs(target)
    by_vectors[found], by_bias[found] = np.add.reduceat(up[:, None] * ahead, starts), np.add.reduceat(up, starts)
    of_drawn = np.empty_like(false)
    for rows, vs, out in zip(parts, false, of_drawn, strict=True):
        back[rows] += down[rows] @ vs
        np.matmul(down[rows].T, ahead[rows], out=out)
    np.add.at(by_vectors, drawn.ravel(), of_drawn.reshape(-1, vectors.shape[1]))
    np.add.at(by_bias, drawn.ravel(), np.add.reduceat(down, [rows.start for rows in parts]).ravel())
    return back, by_vectors, by_bias


class Trainer:
    """Steps of Adagrad on batches of tokens."""

    def __init__(self, net: Net, squares: list[np.ndarray], seed: list[int], noise: int = NOISE, rate: float = RATE):
        self.net, self.squares, self.noise, self.rate, self.rng = net, squares, noise, rate, np.random.default_rng([SEED, *seed])
        self.seen = [np.zeros(len(net.often)), np.zeros(len(net.often))]
        self.of_group = np.add.reduceat(net.often, np.arange(0, len(net.often), WIDE))
        self.before_group = np.cumsum(self.of_group) - self.of_group

    def _drawn(self, often: np.ndarray, begin: np.ndarray, share: np.ndarray, end: np.ndarray | int) -> np.ndarray:
        """Noise for each part, drawn as ``often`` says from the stretch of its running sum that is ``share`` long and ends before class ``end``."""
        at = begin[:, None] + self.rng.random((len(begin), self.noise)) * share[:, None]
        return np.minimum(np.searchsorted(np.cumsum(often), at), end - 1)

    def step(self, classes: np.ndarray, before: np.ndarray) -> None:
        net, order = self.net, np.argsort(classes, kind="stable")
        classes, before = classes[order], before[:, order]
        of, ahead = classes // WIDE, net.predictions(before)
        grads = [np.zeros_like(p) for p in net.params()]
        back, grads[3], grads[4] = _nce(ahead, of, net.group, net.group_bias, self.of_group / self.of_group.sum(), [slice(0, len(of))], self._drawn(self.of_group, np.zeros(1), self.of_group.sum(keepdims=True), len(self.of_group)))
        _, found, starts = _runs(of)
        chance = net.often / np.repeat(self.of_group, WIDE)[: len(net.often)]
        drawn = self._drawn(net.often, self.before_group[found], self.of_group[found], np.minimum((found[:, None] + 1) * WIDE, len(net.often)))
        more, grads[1], grads[2] = _nce(ahead, classes, net.after, net.bias, chance, _slices(starts, len(of)), drawn)
        back += more
        for k, (b, weight) in enumerate(zip(before, net.place, strict=True)):
            order, found, starts = _runs(b)
            grads[0][found] += np.add.reduceat(back[order], starts) * weight
            grads[5][k] = (back * net.before[b]).sum(axis=0)
        for p, g, s in zip(net.params(), grads, self.squares, strict=True):
            s += g * g
            p += self.rate * g / np.sqrt(s)
        for seen, these in zip(self.seen, (before[0], classes), strict=True):
            seen += np.bincount(these, minlength=len(seen))


def _batches(lists: Iterable, most: int = BATCH) -> Iterator[list]:
    """Lists of whole texts with ``most`` tokens or more together, but for the last."""
    held, n = [], 0
    for one in lists:
        held.append(one)
        n += len(one)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _tables(params: list[np.ndarray]) -> list[np.ndarray]:
    """Vectors with their biases as the last column (0 where there are none): before, after, group, place."""
    before, after, bias, group, group_bias, place = params
    return [np.hstack([m, np.zeros((len(m), 1), np.float32) if b is None else b[:, None]]) for m, b in ((before, None), (after, bias), (group, group_bias), (place, None))]


def _params(tables: list[np.ndarray]) -> list[np.ndarray]:
    before, after, group, place = tables
    return [np.ascontiguousarray(x) for x in (before[:, :-1], after[:, :-1], after[:, -1], group[:, :-1], group[:, -1], place[:, :-1])]


def train(encoded: DataFrame, often: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> Net:
    """The model after ``rounds`` of training in parallel and averaging, each over its own slice of the texts (``classes``, ``slice``).

    A vector is weighted by the times its class occurred in the task; classes that never occur stay as they were. In each round a task
    returns as many rows as there are classes, whatever its part; a long text takes several steps.
    """
    net = Net.fresh(often, width)
    squares = [np.full_like(p, 1e-6) for p in net.params()]
    for number in range(rounds):
        net, squares = _round(encoded.where(F.pmod("slice", F.lit(rounds)) == number).select("classes"), net, squares, number)
    return net


def _round(texts: DataFrame, net: Net, squares: list[np.ndarray], number: int) -> tuple[Net, list[np.ndarray]]:
    shared = texts.sparkSession.sparkContext.broadcast((net, squares))
    width = net.before.shape[1]
    values = [f"v{k}" for k in range(width + 1)]

    def run(batches):
        start, begun = shared.value
        own = Net(*[p.copy() for p in start.params()], start.often)
        trainer = Trainer(own, [s.copy() for s in begun], [TaskContext.get().partitionId(), number])
        for some in _batches(np.frombuffer(text.as_py(), np.int16) for batch in batches for text in batch.column(0)):
            now, before = windows(some)
            for at in range(0, len(now), 2 * BATCH):
                trainer.step(now[at : at + 2 * BATCH], before[:, at : at + 2 * BATCH])
        as_before, as_after = trainer.seen
        weights = [as_before, as_after, *(np.full(n, as_after.sum()) for n in (len(own.group), CONTEXT))]
        for kind, table in enumerate([*_tables(own.params()), *_tables(trainer.squares)]):
            weight = weights[kind % 4]
            some = np.flatnonzero(weight)
            columns = [np.full(len(some), kind, np.int32), some.astype(np.int32), weight[some], *(table[some].astype(np.float64) * weight[some, None]).T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "row", "weight", *values])

    schema = "kind int, row int, weight double, " + ", ".join(f"{v} double" for v in values)
    # Sums in another order differ in their last digits; rounding makes reruns agree.
    mean = texts.mapInArrow(run, schema).groupBy("kind", "row").agg(*(F.round(F.sum(v) / F.sum("weight"), 6).alias(v) for v in values)).toArrow()
    tables = [*_tables(net.params()), *_tables(squares)]
    kinds, places = (mean.column(c).to_numpy() for c in ("kind", "row"))
    table = np.stack([mean.column(v).to_numpy() for v in values], axis=1).astype(np.float32) if len(kinds) else np.empty((0, width + 1), np.float32)
    for kind, target in enumerate(tables):
        target[places[kinds == kind]] = table[kinds == kind]
    return Net(*_params(tables[:4]), net.often), [np.maximum(s, 1e-6) for s in _params(tables[4:])]


@dataclass
class Model:
    """What tasks need: frequent tokens with their log10(n + 1), the first ``head`` of them classes of their own, log10 of the
    sum of n + 1 over each ending's tokens and one that was never seen, and the net once it is trained."""

    known: dict[bytes, int]
    logs: np.ndarray
    seen: np.ndarray
    head: int
    class_of: list[int]
    masses: np.ndarray
    net: Net | None = None


def encode(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, slice (as in ``rows``) and of each text: n_tokens, n_known, logs and tail (what frequent tokens add to the base
    score, and to the model's inside the classes of endings), rare and times (its other tokens), classes (int16 of all tokens)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("tail", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())), ("classes", pa.binary())]

    def rows_of(m: Model, texts: list[list[bytes]]) -> Iterator[tuple]:
        flat = list(chain.from_iterable(texts))
        at = np.fromiter(map(m.known.get, flat, repeat(-1)), np.int64, len(flat))
        # A frequent token's class is looked up by its number; a rare one has that of its ending.
        classes = np.asarray(m.class_of, np.int16)[at]
        rare = np.flatnonzero(at < 0)
        classes[rare] = [m.head + ending(flat[k]) for k in rare.tolist()]
        logs, known, tail = np.where(at >= 0, m.logs[at], 0.0), (at >= 0) & m.seen[at], np.zeros(len(at))
        # In the class of an ending a token's share is (n + 1) over a fixed sum; the rare ones' n is joined later.
        inside = np.flatnonzero(classes >= m.head)
        tail[inside] = logs[inside] - m.masses[classes[inside] - m.head]
        end = 0
        for found in texts:
            part = slice(end, end := end + len(found))
            missing = Counter(found[k] for k in np.flatnonzero(at[part] < 0).tolist())
            yield len(found), int(known[part].sum()), float(logs[part].sum()), float(tail[part].sum()), list(missing), list(missing.values()), classes[part].tobytes()

    def run(batches):
        for batch in batches:
            found = [row for some in _batches(tokens(text.as_py()) for text in batch.column(3)) for row in rows_of(shared.value, some)]
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            columns = [pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "held_out", "slice", *(k for k, _ in kinds)])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, slice long, n_tokens long, n_known long, logs double, tail double, rare array<binary>, times array<long>, classes binary"
    return rows.select("doc_id", "held_out", "slice", "text").mapInArrow(run, schema)


def fit(docs: DataFrame, out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model, int, int, DataFrame]:
    """The token counts as a table, the model, N and V, learned where ``out`` is false (default: everywhere), and the encoded texts of all rows."""
    out = F.lit(False) if out is None else F.coalesce(out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.xxhash64(F.col(text_col)).alias("slice"), F.col(text_col).alias("text"))
    counts = materialise(token_counts(rows.where("not held_out")), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = frequent_tokens(counts)
    head = frequent[:HEAD]
    rest, masses = np.zeros(ENDINGS), np.ones(ENDINGS)
    of = F.crc32(F.substring("token", -ENDING, ENDING)) % ENDINGS
    for e, n, several in counts.groupBy(of.alias("ending")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        rest[e] += n
        masses[e] += n + several
    for token, n in head:
        if n:
            rest[ending(token)] -= n
            masses[ending(token)] -= n + 1
    classes = Classes(t for t, _ in head)
    seen = np.array([n for _, n in frequent], dtype=np.float64)
    model = Model({t: i for i, (t, _) in enumerate(frequent)}, np.log10(seen + 1), seen > 0, len(head), [classes[t] for t, _ in frequent], np.log10(masses))
    encoded = materialise(encode(rows, model), "encoded")
    net = train(encoded.where("not held_out"), np.concatenate([[n for _, n in head], rest]))
    return counts, replace(model, net=net), total, distinct, encoded


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 p of the text).

    Learns from the rows where ``out`` is false (default: CRC-32 of the id as text does not leave 2 when divided by 7).
    A null text counts as empty and consists of the end alone; repeated rows are each returned; a null id counts as empty
    text for the fold. Without training rows N and V are 0. Other columns are ignored; an empty table gives no rows.
    """
    out = held_out(F.col(id_col), 7, 2) if out is None else out
    counts, model, total, distinct, encoded = fit(docs, out, id_col, text_col)
    shared, base = docs.sparkSession.sparkContext.broadcast(model.net), math.log10(total + distinct + 1)

    def run(batches):
        net = shared.value
        for batch in batches:
            found = [np.empty(0)]
            for some in _batches(np.frombuffer(text.as_py(), np.int16) for text in batch.column(batch.num_columns - 1)):
                now, before = windows(some)
                steps = range(0, len(now), 2 * BATCH)
                logs_p = np.concatenate([net.log10_p(now[k : k + 2 * BATCH], before[:, k : k + 2 * BATCH]) for k in steps])
                lengths = np.array([len(text) for text in some])
                found.append(np.add.reduceat(logs_p, np.cumsum(lengths) - lengths))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found))], [*batch.schema.names[:-1], "net_score"])

    passed = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "tail", "rare", "times"]
    schema = ", ".join(f"{c} {dict(encoded.dtypes)[c]}" for c in passed) + ", net_score double"
    local = materialise(encoded.select(*passed, "classes").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")

    rare = local.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    joined = rare.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"))
    whole = local.drop("rare", "times").join(sums, "row", "left").withColumn("rare_logs", F.coalesce("rare_logs", F.lit(0.0)))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("net_score") + F.col("tail") + F.col("rare_logs")).alias("score"),
    )
