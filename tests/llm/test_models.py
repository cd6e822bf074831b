import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lbl, rules, urls


def sentences(n, seed=1):
    r = random.Random(seed)
    after = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["ran", "sat"], "sat": ["the", "down"], "ran": ["the", "off"]}
    out = []
    for _ in range(n):
        words = ["the"]
        while words[-1] in after and len(words) < 30:
            words.append(r.choice(after[words[-1]]))
        if r.random() < 0.3:
            words.append(f"rare{r.randint(0, 60)}")
        out.append(" ".join(words))
    return out


def lm_rows():
    rows = list(enumerate(sentences(300)))
    return [*rows, (900, None), (901, ""), (None, "The CAT É zzz zzz"), (3, rows[3][1]), (902, "q" * 90)]


def held(i, folds, fold):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == fold


@pytest.mark.parametrize("frequent", [lbl.FREQUENT, 6])
def test_lm_counts_and_unigram_base_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lbl.frequent_tokens, "__defaults__", (frequent,))
    rows = lm_rows()
    counts = Counter(t for i, x in rows if not held(i, 7, 2) for t in lbl.tokens(x))
    n, v = sum(counts.values()), len(counts)
    got = lbl.score_texts(spark.createDataFrame([(i, t, 1.0, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")).collect()
    want = [(i, held(i, 7, 2), len(lbl.tokens(t)), sum(counts[x] > 0 for x in lbl.tokens(t)), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in lbl.tokens(t))) for i, t in rows]
    key = lambda x: repr((x[0], x[2], x[3]))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    if frequent > 6:
        out = [x for x in got if x.held_out]
        assert sum(x.score for x in out) > sum(x.base_score for x in out) + 5


def brute_score(model, counts, text):
    """log10 p of a text, token by token, from the net's vectors and the counts of all training tokens."""
    net, total, classes = model.net, 0.0, [0] * lbl.CONTEXT
    head = {t: k for t, k in model.known.items() if k < model.head}
    softmax = lambda z: [x / sum(math.exp(y) for y in z) for x in map(math.exp, z)]
    endings = Counter()
    for t, n in counts.items():
        if t not in head:
            endings[zlib.crc32(t[-3:]) % lbl.ENDINGS] += n + 1
    for t in lbl.tokens(text):
        c = head[t] if t in head else model.head + zlib.crc32(t[-3:]) % lbl.ENDINGS
        ahead = sum(net.before[classes[-k]].astype(float) * net.place[k - 1] for k in range(1, lbl.CONTEXT + 1))
        group, start = c // lbl.WIDE, c // lbl.WIDE * lbl.WIDE
        p = softmax([float(ahead @ v + b) for v, b in zip(net.group, net.group_bias)])[group]
        members = range(start, min(start + lbl.WIDE, len(net.after)))
        p *= softmax([float(ahead @ net.after[m] + net.bias[m]) for m in members])[c - start]
        if t not in head:
            p *= (counts[t] + 1) / (endings[c - model.head] + 1)
        total += math.log10(p)
        classes.append(c)
    return total


@pytest.mark.parametrize("frequent", [lbl.FREQUENT, 6])
def test_lm_score_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lbl, "HEAD", 12)
    monkeypatch.setattr(lbl.frequent_tokens, "__defaults__", (frequent,))
    rows = lm_rows()
    texts = spark.createDataFrame([(i, t, held(i, 7, 2)) for i, t in rows], "doc_id long, text string, out boolean")
    counts = Counter(t for i, x in rows if not held(i, 7, 2) for t in lbl.tokens(x))
    model = lbl.fit(texts, F.col("out"))[1]
    got = sorted((lbl.tokens(t), s) for t, s in lbl.score_texts(texts, out=F.col("out")).join(texts, "doc_id").select("text", "score").distinct().collect())
    assert len({repr(t) for t, _ in got}) > 50
    for found, score in got:
        assert score == pytest.approx(brute_score(model, counts, b" ".join(found[:-1]).decode()), rel=1e-4)


def test_lm_probabilities_are_normalised(spark, monkeypatch):
    """Over the training vocabulary and one unknown token for each ending, the probabilities after any context add up to 1."""
    monkeypatch.setattr(lbl, "HEAD", 12)
    texts = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    counts, model, total, distinct, _ = lbl.fit(texts)
    size = len(model.net.after)
    assert size == 12 + lbl.ENDINGS and total == sum(r["n"] for r in counts.collect())
    for context in ([0, 0, 0], [3, 0, 0], [50, 5, 1]):
        before = np.repeat(np.array(context)[:, None], size, axis=1)
        assert (10 ** model.net.log10_p(np.arange(size), before)).sum() == pytest.approx(1, rel=1e-5)
    inside = Counter({e: 1 for e in range(lbl.ENDINGS)})
    for r in counts.collect():
        if model.known.get(bytes(r["token"]), model.head) >= model.head:
            inside[lbl.ending(bytes(r["token"]))] += r["n"] + 1
    assert [10**x for x in model.masses] == pytest.approx([inside[e] for e in range(lbl.ENDINGS)])
    assert lbl.score_texts(texts.limit(0)).count() == 0


def test_many_equal_counts_do_not_empty_the_list_of_frequent_tokens(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 3) for i in range(5_000)] + [(lbl.END, 7)], "token binary, n long")
    assert 2_900 < len(lbl.frequent_tokens(counts, 3_000)) <= 3_001


def test_nce_with_drawn_noise_learns_conditional_distributions():
    """Classes in two groups follow a chain with one token of memory two tokens back; other places of the context are noise."""
    r = np.random.default_rng(0)
    size = 100
    follow = r.permutation(size)
    text = [0, 1]
    for _ in range(60_000):
        text.append(int(follow[text[-2]]) if r.random() < 0.8 else int(r.integers(size)))
    net = lbl.Net.fresh(np.bincount(text, minlength=size), 32)
    trainer = lbl.Trainer(net, [np.full_like(p, 1e-6) for p in net.params()], [0])
    now, before = lbl.windows([text])
    for _ in range(12):
        for at in range(0, len(now), 2_000):
            trainer.step(now[at : at + 2_000], before[:, at : at + 2_000])
    p = 10 ** net.log10_p(follow[before[1, 100:]], before[:, 100:])
    assert p.mean() > 0.65
    assert net.log10_p(now, before).mean() > -0.75  # the unigram distribution has -2


def test_rules_from_trees_and_lasso():
    tree = """DecisionTreeClassificationModel
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 3.0)
    Predict: 1.0
   Else (feature 0 > 3.0)
    Predict: 0.0
"""
    found = {r.bounds for r in rules.tree_rules(tree, ["a", "b"])}
    inf = math.inf
    assert found == {(("a", -inf, 0.5),), (("a", -inf, 0.5), ("b", -inf, 2.0)), (("a", -inf, 0.5), ("b", 2.0, inf)), (("a", 0.5, inf),), (("a", 0.5, 3.0),), (("a", 3.0, inf),)}
    r = np.random.default_rng(1)
    x = (r.random((4000, 30)) < 0.5).astype(float)
    y = (r.random(4000) < 1 / (1 + np.exp(-(3 * x[:, 2] - 2 * x[:, 7])))).astype(float)
    w, _ = rules.lasso_logistic(x, y, penalty=0.02)
    assert set(np.flatnonzero(w)) == {2, 7} and w[2] > 0 > w[7]


def test_compiled_rules_equal_brute_force(spark):
    """The columns that rules compile to against the rules themselves and a plain sum, at and around their bounds."""
    r = np.random.default_rng(5)
    rows = {f: r.integers(0, 5, 300) / 2 for f in "abc"}
    found = [rules.Rule((("a", -math.inf, 1.0),), 0.7), rules.Rule((("a", 0.5, 2.0), ("b", 1.0, math.inf)), -1.3), rules.Rule((("b", 0.0, 0.5), ("c", -math.inf, 2.0)), 0.25), rules.Rule((("c", 2.0, math.inf),), 2.0)]
    df = spark.createDataFrame([(i, *(float(rows[f][i]) for f in "abc")) for i in range(300)], "i int, a double, b double, c double")
    got = df.select("i", rules.rule_score(found, -0.4).alias("score"), *(x.column().alias(f"h{k}") for k, x in enumerate(found))).orderBy("i").collect()
    for i, row in enumerate(got):
        held = [all(low < rows[f][i] <= high for f, low, high in x.bounds) for x in found]
        assert [row[f"h{k}"] for k in range(4)] == held == [bool(x.holds(rows)[i]) for x in found]
        assert row.score == pytest.approx(1 / (1 + math.exp(0.4 - sum(x.weight for x, h in zip(found, held, strict=True) if h))))


def test_lasso_reaches_the_optimum_of_a_plain_loop():
    r = np.random.default_rng(6)
    x = (r.random((500, 6)) < 0.4).astype(float)
    y = (r.random(500) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 3] - 0.3)))).astype(float)

    def loss(w, b):
        z = x @ w + b
        return float(np.mean(np.logaddexp(0, z) - y * z) + 0.01 * np.abs(w).sum())

    w, b = np.zeros(6), 0.0
    for _ in range(20_000):  # proximal gradient, without acceleration, small steps
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = w - 0.5 * x.T @ miss / 500
        w, b = np.sign(w) * np.maximum(np.abs(w) - 0.5 * 0.01, 0), b - 0.5 * miss.mean()
    got = rules.lasso_logistic(x, y, penalty=0.01)
    assert loss(*got) == pytest.approx(loss(w, b), abs=1e-5) and set(np.flatnonzero(np.abs(got[0]) > 1e-4)) == set(np.flatnonzero(np.abs(w) > 1e-4))


def test_quality_scores(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = r.random() < 0.7
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(words).capitalize() + "." if good else "!! ".join(w.upper() for w in words), 0.1))
        labels.append((i, int(good), 0))
    rows += [(900, None, 0.1), (901, "", 0.1), (None, "abc", 0.1), (5, rows[5][1], 0.1)]
    labels += [(None, 1, 1), (7000, 0, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rules.score_quality(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert all(x.held_out == held(x.doc_id, 5, 0) for x in got)
    truth = {i: q for i, q, _ in labels}
    out = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 400]
    assert np.mean([x.predicted == truth[x.doc_id] for x in out]) > 0.95
    again = rules.score_quality(docs, known.limit(0)).collect()
    assert all(x.score == pytest.approx(0.5) for x in again)
    assert rules.score_quality(docs.limit(0), known).count() == 0


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/es/1?x=1", "https://example.org/en/12", "http://xexample.org/es/2", "ftp://b.COM/fr/9#t", "http://b.com/de/3", "x://y://org/", "http://net/a/b?q=1&r", "http://sub.com?/fr/"]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    h = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    p = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:h]), rest[h:p]


def brute_rule(h, p):
    fits = [(len(a + b), a + b, v) for v, a, b in urls.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
    return max(fits)[1:] if fits else (None, None)


def wilson(hits, rows):
    """The share p at which ``hits`` of ``rows`` lie DEVIATIONS standard deviations above expectation, by bisection."""
    low, high = 0.0, hits / rows
    for _ in range(60):
        p = (low + high) / 2
        if hits - rows * p > urls.DEVIATIONS * math.sqrt(rows * p * (1 - p)):
            low = p
        else:
            high = p
    return low


def test_mined_rules_hold_on_urls_they_were_not_learned_from(spark):
    """Precision on held-out labels is at least the confidence, noise alone gives no rule, and long templates are no burden."""
    r = random.Random(8)
    template = [f"q:{k}" for k in range(40)]

    def some(signal):
        hosts = [f"h:{r.choice(['pills', 'win', 'news', 'blog', 'shop'])}", f"h:{r.choice('abcdefghij')}", f"p:{r.choice(['en', 'de'])}"]
        bad = r.random() < (0.95 if signal and "h:pills" in hosts and "p:en" in hosts else 0.2)
        return sorted(hosts + (template if r.random() < 0.5 else [])), bad

    for signal in (True, False):
        rows = [some(signal) for _ in range(4_000)]
        learned = spark.createDataFrame(rows[:3_000], "tokens array<string>, blocked boolean")
        found, classes = urls.mine(learned)
        assert {x.item for x in classes.collect() if x.token.startswith("q:")} == {"q:0"}
        blocked = {tuple(x.tokens) for x in urls.matching(spark.createDataFrame(rows[3_000:], learned.schema), found, classes).collect()}
        hits = [bad for tokens, bad in rows[3_000:] if tuple(tokens) in blocked]
        if signal:
            wanted = [bad for tokens, bad in rows[3_000:] if {"h:pills", "p:en"} <= set(tokens)]
            assert sum(hits) >= urls.CONFIDENCE * len(hits) and sum(hits) >= 0.9 * sum(wanted) > 0
        else:
            assert not hits


def test_urls_equal_brute_force(spark):
    r = random.Random(6)
    pages = [(i, u) for i, u in enumerate(URLS)]
    for i in range(100, 500):
        pages.append((i, f"http://{r.choice(['a', 'b', 'spam'])}.{r.choice(['net', 'com', 'org'])}/{r.choice(['fr', 'de', 'en'])}/{i}{r.choice(['', '?u=1', '#x'])}"))
    labels = [(i, int("spam" not in u), 0) for i, u in pages if i >= 100 and i % 2]
    table = spark.createDataFrame([(i, u, "h") for i, u in pages] + [(None, URLS[5], "h")], "page_id long, url string, host string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge(table, known, support=0.01).collect()
    assert len(got) == len(pages) + 1
    url_of, bad = dict(pages), {i: q == 0 for i, q, _ in labels}
    tokens = {u: tuple(t) for u, t in table.select("url", urls.tokens(table["url"])).collect()}
    # Brute force over all combinations of tokens of the labelled URLs.
    baskets = []
    for i, u in [*pages, (None, URLS[5])]:
        verdict = brute_rule(*brute_parts(u))[1]
        blocked = None if verdict else bad.get(i)
        if blocked is not None and tokens[u]:
            baskets.append((tokens[u], blocked))
    seen, blocked_in = Counter(), Counter()
    for ts, blocked in baskets:
        for k in range(1, 1 << len(ts)):
            some = tuple(t for j, t in enumerate(ts) if k >> j & 1)
            seen[some] += 1
            blocked_in[some] += blocked
    least = math.ceil(0.01 * len(baskets))
    mined = {s for s in seen if blocked_in[s] >= least and wilson(blocked_in[s], seen[s]) >= urls.CONFIDENCE}
    assert any("h:spam" in s for s in mined)
    for x in got:
        u = URLS[5] if x.page_id is None else url_of[x.page_id]
        h, p = brute_parts(u)
        rule, verdict = brute_rule(h, p)
        hit = any(set(s) <= set(tokens[u] or ()) for s in mined)
        assert tuple(x)[1:] == (h, p, rule, verdict or ("block" if hit else "allow")), u
    assert {x.verdict for x in urls.judge(table.limit(3), known.limit(0)).collect()} == {"allow"}
    assert urls.judge(table.limit(0), known).count() == 0


def test_a_step_takes_two_passes_and_equals_a_plain_loop(monkeypatch):
    """Groups and members are each one pass over the batch, however many groups there are; gradients are those of NCE token by token."""
    rng = np.random.default_rng(5)
    often = rng.integers(1, 50, 3 * lbl.WIDE + 9).astype(float)
    net = lbl.Net.fresh(often, 4)
    start, calls, nce = [p.astype(float) for p in net.params()], [], lbl._nce
    monkeypatch.setattr(lbl, "_nce", lambda *a: calls.append(a[-1]) or nce(*a))
    trainer = lbl.Trainer(net, [np.full_like(p, 1e-6) for p in net.params()], [0], noise=5)
    classes, before = lbl.windows([rng.integers(0, len(often), n) for n in (40, 1, 30)])
    trainer.step(classes, before)
    assert len(calls) == 2

    words, after, bias, group, group_bias, place = start
    grads, present = [np.zeros_like(p) for p in start], sorted(set((classes // lbl.WIDE).tolist()))
    share = net.often + 0.0
    of_group = np.add.reduceat(share, np.arange(0, len(share), lbl.WIDE))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for c, *b in zip(classes, *before, strict=True):
        ahead = sum(words[x] * w for x, w in zip(b, place, strict=True))
        g, back = c // lbl.WIDE, 0
        assert all(d // lbl.WIDE == g for d in calls[1][present.index(g)])
        for target, drawn, vectors, biases, chance, into in (
            (g, calls[0][0], group, group_bias, of_group / of_group.sum(), (3, 4)),
            (c, calls[1][present.index(g)], after, bias, share / np.repeat(of_group, lbl.WIDE)[: len(share)], (1, 2)),
        ):
            for one, real in [(target, True), *((d, False) for d in drawn)]:
                pull = real - sigmoid(ahead @ vectors[one] + biases[one] - np.log(5 * chance[one]))
                grads[into[0]][one] += pull * ahead
                grads[into[1]][one] += pull
                back = back + pull * vectors[one]
        for k, x in enumerate(b):
            grads[0][x] += back * place[k]
            grads[5][k] += back * words[x]
    for s, g in zip(trainer.squares, grads, strict=True):
        assert s == pytest.approx(g * g + 1e-6, rel=1e-3, abs=1e-5)
