"""Mixing, language model, near duplicates, quality, neighbours and the pipeline: brute force on small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import ann, jaccard, line_crf, mixing, ngram_lm
from lamina.llm import components as components_module
from lamina.llm.common import written
from lamina.llm.components import components

SF = "/root/testdata/sf0.001"


def _targets(sizes: dict, share: float = 1.5, most: float = 2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 300]))), rng.choice(["a", "b", "é", "日", "", None] + ["hot"] * 4)) for i in range(900)]
    rows += [(900, None, "a"), (None, "no id at all", "b"), (5, rows[5][1], rows[5][2]), (901, "w " * 20_000, "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("size", "taken", "target", "block", "shard")})
    mixed = mixing.mix(df, block_words=16, shard_slots=100)
    got = mixed.documents.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = _targets(dict(sizes))
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 33 for s in sizes)
    again = mixing.mix(df.repartition(7), block_words=16, shard_slots=100).documents
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(got) == key(again.collect())
    blocks = mixed.slots.groupBy("source_no", "pass_no").agg(F.count("*").alias("n"), F.countDistinct("block").alias("d")).collect()
    assert all(r["n"] == r["d"] for r in blocks)  # a pass takes no block twice
    assert mixed.slots.groupBy("shard").count().agg(F.max("count")).first()[0] <= 100


def _lm_scores(rows: list, held: list[bool], order: int, mass: float) -> list[float]:
    """Log10 probabilities by the definition: Dirichlet-smoothed n-grams over discounted shares, from plain counts."""
    tokens = [(t or "").lower().split() + [None] for _, t in rows]
    counts = [Counter() for _ in range(order)]
    for seq, out in zip(tokens, held):
        for i in range(len(seq)) if not out else ():
            for k in range(order):
                counts[k][tuple(["^"] * (k - i) + seq[max(0, i - k) : i + 1])] += 1
    one = counts[0]
    total, kinds = sum(one.values()), len(one)
    n1, n2 = (sum(c == n for c in one.values()) for n in (1, 2))
    d = min(max((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.05), 0.95)
    seen = [Counter() for _ in range(order)]
    for k in range(1, order):
        for g, c in counts[k].items():
            seen[k][g[:-1]] += c

    def p(gram: tuple) -> float:
        k = len(gram) - 1
        if not k:
            return 1.0 if not total else (one[gram] - d) / total if one[gram] else d * kinds / total
        return (counts[k][gram] + mass * p(gram[1:])) / (seen[k][gram[:-1]] + mass)

    return [sum(math.log10(p(tuple(["^"] * (order - 1 - i) + seq[max(0, i - order + 1) : i + 1]))) for i in range(len(seq))) for seq in tokens]


def test_language_model_units():
    """After every history the probabilities sum to one, and failure arcs lead to shorter histories."""
    rng = np.random.default_rng(1)
    m, lengths = 6, np.array([9, 0, 30, 200, 1])
    chunk = ngram_lm.Chunk(lengths, np.zeros(5, bool), rng.integers(0, m, lengths.sum()).astype(np.int32), np.arange(m, dtype=np.uint64) + 10)
    for order in (2, 3, 4):
        grams = chunk.grams(order)
        totals = [g.counts.copy() for g in grams]
        root = totals[0] / totals[0].sum()
        made, _, _ = ngram_lm.automaton(chunk, grams, totals, root, 5, 3.0)
        assert (np.diff(made.keys) > 0).all() and (made.fail[1:] < np.arange(1, len(made.fail))).all()
        for s in range(len(made.fail)):
            weight, target = made.step(np.full(m + 1, s), np.arange(m + 1))
            assert (10**weight).sum() == pytest.approx(1) and target.max() < len(made.fail)
        assert all(len(g.kinds) == len(np.unique(g.hashes)) for g in grams)


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "_CHUNK_BYTES", 3000)
    monkeypatch.setattr(ngram_lm, "_RANGE_KEYS", 500)
    monkeypatch.setattr(ngram_lm, "_PIECE", 100)
    monkeypatch.setattr(ngram_lm, "_PART", 7)
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocab[: 3 + i % 200]) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(300, None), (301, "UPPER unseen-word W1"), (None, "w1 w2"), (7, "w1"), (7, "w1"), (302, " \n"), (303, "w5 w6 w7 \n" * 2000), (304, "long" * 1000 + " w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "score", "held_out", "word", "c", "n", "ids", "part")}).repartition(3)
    got = ngram_lm.score(df.drop("held_out"), F.col("doc_id") % 7 == 2, order=order, mass=5.0).collect()
    held = [i is not None and i % 7 == 2 for i, _ in rows]
    tokens = lambda t: (t or "").lower().split() + [None]
    counts = Counter()
    for (_, t), out in zip(rows, held):
        if not out:
            counts.update(tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in tokens(t)) for _, t in rows]
    want = [(str(i), out, len(w := tokens(t)), sum(counts[x] > 0 for x in w), total, round(b, 6), round(s, 6)) for (i, t), out, b, s in zip(rows, held, base, _lm_scores(rows, held, order, 5.0))]
    key = lambda r: (*r[:5], round(r[5], 3))
    found = sorted(((str(r["doc_id"]), *r[1:]) for r in got), key=key)
    for f, w in zip(found, sorted(want, key=key), strict=True):
        assert f[:5] == w[:5] and f[5:] == pytest.approx(w[5:], abs=1e-5)
    everything = ngram_lm.score(df.drop("held_out"), F.lit(True), order=order).collect()  # nothing to train on
    assert len(everything) == len(rows) and all(r["score"] == 0 for r in everything)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)] + [(9, 9), (7777, 7777)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


def _linked(rows, words: int, percent: int) -> dict:
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return sorted((str(rows[i][0]), len(sets[i]), str(min((rows[j][0] for j in g if rows[j][0] is not None), default=None))) for g in groups.values() for i in g)


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 1024), (5, 80, 1024), (2, 95, 1024), (4, 85, 7)])
def test_jaccard(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "_BLOCK_SETS", block)
    rng = random.Random(words * percent)
    vocab = [f"w{i}" for i in range(500)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(1, 150))] for _ in range(30)]
    passage = [rng.choice(vocab) for _ in range(12)]
    rows = []
    for i in range(500):
        w = list(bases[0] if rng.random() < 0.3 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w += passage
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (505, "one two"), (None, rows[3][1]), (3, rows[3][1]), (506, " ".join(f"x{i}" for i in range(20_000))), (507, " ".join(f"x{i}" for i in range(20_100)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("class_id", "component_id", "shingle", "size", "n")}).repartition(5)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.link(df, words=words, percent=percent).collect())
    assert got == _linked(rows, words, percent)


def test_jaccard_tells_sets_of_one_hash_apart(spark):
    """Two sets with one 64-bit number are two classes: by their second hashes."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "one two three four five six"]
    sets = jaccard.Shingler(4).sets(texts)
    number = jaccard._class(sets[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["component_id"]) for r in jaccard.link(df, _shared_ids=frozenset([number])).collect()}
    assert got == {0: (jaccard._second(sets[0]), 0), 1: (jaccard._class(sets[1]), 1), 2: (jaccard._second(sets[0]), 0)}
    plain = {r["doc_id"]: r["class_id"] for r in jaccard.link(df).collect()}
    assert plain == {0: number, 1: jaccard._class(sets[1]), 2: number}


def test_trie_links():
    rng = random.Random(3)
    for _ in range(150):
        base = [rng.randrange(10**6) for _ in range(rng.randint(1, 200))]

        def changed() -> np.ndarray:
            s = set(base if rng.random() < 0.8 else [rng.randrange(10**6) for _ in range(rng.randint(1, 200))])
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                s.symmetric_difference_update({rng.choice(base) if rng.random() < 0.5 else rng.randrange(10**6)})
            return np.array(sorted(s or {1}), dtype=np.int64)

        left, right = [changed() for _ in range(rng.randint(1, 20))], [changed() for _ in range(rng.randint(1, 20))]
        want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b))}
        assert {(i, j) for i, found in jaccard.trie_links(left, right, 85) for j in found.tolist()} == want


def test_quality_units():
    rng = np.random.default_rng(4)
    crf = line_crf.LineCRF(np.zeros(1), 0.0, 0.7, 0.2)
    for n in (1, 2, 5, 9):
        odds = rng.normal(size=n) * 2
        weights = {}
        for path in range(1 << n):
            y = [path >> i & 1 for i in range(n)]
            same = sum(0.7 if a and b else 0.2 if a == b else 0.0 for a, b in zip(y, y[1:]))
            weights[path] = math.exp(same + sum(o for o, v in zip(odds, y) if v))
        total = sum(weights.values())
        want = [sum(w for p, w in weights.items() if p >> i & 1) / total for i in range(n)]
        assert crf.marginals(odds.tolist()) == pytest.approx(want)
    x, sizes, first = line_crf.features(["", "a\n\nb b b\n", "\n", "Ünï"])
    assert x.shape == (len(sizes), line_crf.N_FEATURES) and first.tolist() == [0, 1, 5, 7, 8] and sizes.sum() == 11


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    crf = line_crf.fit(docs, labels, fold != 0)
    held = line_crf.score(docs, crf).join(labels, "doc_id").filter(fold == 0).select("score", "quality").collect()
    assert np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in held]) > 0.95
    rows = [(0, ""), (1, None), (2, "x"), (None, "no id."), (3, "line\n" * 30_000), (3, "line\n" * 30_000)]
    got = line_crf.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(1)), crf).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert line_crf.fit(docs, labels.limit(0), fold != 0) is None and line_crf.score(docs.limit(3), None).filter("score = 0.5").count() == 3


def test_quality_scores_by_definition(spark):
    """Each document's score from sums over labelings kept as two-by-two products, without messages."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    crf = line_crf.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in line_crf.score(docs, crf).select("doc_id", "score").collect()}
    step = np.exp([[crf.bad, 0.0], [0.0, crf.good]])
    for r in docs.orderBy("doc_id").limit(60).collect():
        x, sizes, _ = line_crf.features([r["text"]])
        own = [np.diag([1.0, math.exp(z)]) for z in np.clip(x @ crf.weights + crf.bias, -30, 30)]
        total = share = 0.0
        for t in range(len(own)):
            left = right = np.ones(2)
            for a in own[:t]:
                left = (left @ a) @ step
                left = left / left.sum()
            for a in own[:t:-1]:
                right = step @ (a @ right)
                right = right / right.sum()
            both = left * np.diag(own[t]) * right
            share += both[1] / both.sum() * (sizes[t] + 1)
            total += sizes[t] + 1
        mean = min(max(share / total, 1e-6), 1 - 1e-6)
        want = 1 / (1 + math.exp(-min(max(crf.scale * math.log(mean / (1 - mean)) + crf.shift, -50), 50)))
        assert got[r["doc_id"]] == pytest.approx(want, abs=1e-5)


def test_quality_trains_on_lines_in_a_row(spark, monkeypatch):
    """All lines of a long text, in windows of neighbours; labels decide, ids without text don't."""
    seen = {}
    monkeypatch.setattr(line_crf, "train", lambda x, sizes, labels: seen.update(x=x, sizes=sizes, labels=labels))
    lines = [f"line {'x' * (i % 37)} {i}" for i in range(1000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "short"), (3, None), (4, "unlabelled")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (99, 1), (None, 1), (4, None)], "doc_id long, quality int")
    line_crf.fit(docs, labels, F.lit(True), window=150)
    assert [len(x) for x in seen["sizes"]] == [150] * 6 + [100, 1, 1] and seen["labels"] == [1] * 7 + [0, 0]
    assert np.concatenate(seen["sizes"][:7]).tolist() == [len(x) for x in lines]
    want = line_crf.features(["\n".join(lines)])[0]
    assert np.array_equal(np.concatenate(seen["x"][:7]), want.astype("<f4"))


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "_MOST_BLOCK", 128)
    monkeypatch.setattr(ann, "_MOST_HOME", 700)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1300] = x[0]  # copies
    x[1300:1400] = x[1] + rng.normal(size=(100, 16)).astype(np.float32) * 0.01
    x[40] = 3 * x[50]
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(10, x[10].tolist()), (5000, None), (5050, [0.0] * 16), (5100, [1.0, None] * 8), (5150, [float("nan")] * 16), (5200, [1.0] * 3), (5250, [float("inf")] * 16), (None, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("node", "score", "rank", "vec", "k1")})
    got = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits, asked = 0, range(0, 3000, 50)
    assert sorted(got) == list(asked)
    for q in asked:
        s = np.round(y @ y[q], 12)
        s[q] = -9
        order = np.lexsort((np.arange(3000), -s))[:5]
        hits += len({v for _, v, _ in got[q]} & set(order.tolist()))
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5] and all(abs(c - y[v] @ y[q]) < 1e-12 for _, v, c in got[q])
    assert hits >= 0.95 * 5 * len(asked)
    assert [v for _, v, _ in got[0]] == [1000, 1001, 1002, 1003, 1004]  # ties go to smaller ids
    few = ann.neighbours(df.filter("vec_id in (0, 7, 9)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_neighbours_in_near_copies(spark):
    """A cluster of thousands that differ by less than a byte's rounding."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1, 32)) * (1 + 0.003 * rng.normal(size=(2500, 32)))
    df = spark.createDataFrame(list(enumerate(x.astype(np.float32).tolist())), "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2500, 50):
        s = y @ y[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.95 * 5 * 50, hits


def test_neighbour_graph_settles(spark, monkeypatch):
    """Rounds go on while lists change; the beam follows the number of nodes."""
    monkeypatch.setattr(ann, "_MOST_BLOCK", 32)
    rounds, compared = [], ann._compared
    monkeypatch.setattr(ann, "_compared", lambda *a: rounds.append(1) or compared(*a))
    x = np.random.default_rng(8).normal(size=(2000, 48)).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, vector array<double>")
    homes = ann.in_homes(df.mapInArrow(ann._packed(), "node long, vec binary"), 48, 300)
    assert homes.count() >= 7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for r in ann.lists(ann.build_graph(homes, 48, 2000, least_change=1e-3)).filter("node % 20 = 0").collect():
        s = x @ x[r["node"]]
        assert r["sims"] == pytest.approx(s[r["near"]].tolist(), abs=1e-6) and len(set(r["near"])) == 24
        s[r["node"]] = -9
        hits += len(set(r["near"][:5]) & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 100 and len(rounds) > 3, (hits, rounds)
    assert ann.beam_for(2_000) == 96 and ann.beam_for(50_000) == 320 and ann.beam_for(200_000) == 640


def test_neighbours_of_extreme_magnitudes(spark):
    """Squares beyond the range of doubles."""
    assert ann.block_for(500) == 90 and ann.block_for(10**9) == 2048
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 8))
    scale = 10.0 ** rng.choice([-300, -200, 0, 200, 300], size=(60, 1))
    df = spark.createDataFrame(list(enumerate((x * scale).tolist())), "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = y @ y[q]
        s[q] = -9
        assert [v for v, _ in got[q]] == np.argsort(-s)[:5].tolist() and [c for _, c in got[q]] == pytest.approx(np.sort(s)[::-1][:5].tolist())


def test_neighbours_run_rounds_on_small_tables(spark, monkeypatch):
    rounds, compared = [], ann._compared
    monkeypatch.setattr(ann, "_compared", lambda *a: rounds.append(1) or compared(*a))
    monkeypatch.setattr(ann, "_MOST_HOME", 50)
    monkeypatch.setattr(ann, "_MOST_ASKING", 2)
    x = np.random.default_rng(12).normal(size=(500, 24)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.neighbours(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 500, 50):
        s = y @ y[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert rounds and hits >= 48
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lamina_")]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    odd = spark.createDataFrame([(10_000, None, "en", None, 0), (10_001, "", "en", "src0", 0), (None, "Some plain words here.", "en", "src1", 20)], docs.schema)
    first = corpus_pipeline.quality(spark, docs.unionByName(odd), SF)
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.select("doc_id").collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    second = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert second == {int(i) for i, _, c in _linked(rows, 5, 80) if i == c}
    third = corpus_pipeline.mixture(spark, docs, SF)
    assert third.columns == docs.columns
    words, copies, want, sizes = Counter(), Counter(), Counter(), {}
    for r in docs.collect():
        sizes[r["doc_id"]] = len(r["text"].split())
        want[r["source"]] += sizes[r["doc_id"]]
    for r in third.collect():
        words[r["source"]] += sizes[r["doc_id"]]
        copies[r["doc_id"]] += 1
    assert all(c <= 2 for c in copies.values())
    for source, target in _targets(dict(want)).items():  # within the words of a block and of one document
        longest = max(sizes[r["doc_id"]] for r in docs.filter(F.col("source") == source).collect())
        assert abs(words[source] - target) <= 65 + longest
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    fourth = corpus_pipeline.tokens(spark, third, SF).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert Counter(r["doc_id"] for r in fourth) == copies
    for r in fourth[:100]:
        ids = library.encode(text[r["doc_id"]], add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


_CLASH = ["_score", "_key", "_n", "_share", "_id", "_rows", "class_id", "component_id", "n_shingles", "size", "taken", "copies", "chunk", "row_no", "source_no", "ids", "KEY", "_of", "_stay_id"]


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_on_odd_rows(spark, stage):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, and no rows at all."""
    name, run = corpus_pipeline.STAGES[stage]
    copy = " ".join(f"word{i}" for i in range(40))
    rows = [(3, copy, "a"), (7, copy, "b"), (7, "quite another text of a few words", None), (7, "quite another text of a few words", None), (8, None, "a"), (8, "", "a"), (9, " \n", None), (9, " \n", None), (None, copy, "a"), (None, "no id here", "b"), (None, "no id here", "b"), (3, copy + " end", "a"), (10, "long words " * 30_000, "c")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in _CLASH}).repartition(3)
    got = run(spark, df, SF).collect()
    assert run(spark, df.limit(0), SF).collect() == []
    if stage == 3:
        assert len(got) == len(rows) and sorted(r["n_tokens"] for r in got)[:2] == [1, 1]
        return
    assert all(r[c] == f"own {c}" for r in got for c in _CLASH) and set(got[0].asDict()) == set(df.columns)
    found = Counter((r["doc_id"], r["text"]) for r in got)
    if stage == 0:
        assert set(found) <= {(i, t) for i, t, _ in rows}
    elif stage == 1:
        groups = [{(3, copy), (3, copy + " end")}, {(7, "quite another text of a few words")}, {(None, "no id here")}, {(10, "long words " * 30_000)}]
        assert all(sum(found[x] for x in g) == 1 for g in groups)
        assert found[8, None] == found[8, ""] == 1 and found[9, " \n"] == 2 and sum(found.values()) == 8
    else:
        words, sizes = Counter(), Counter()
        for _, t, s in rows:
            sizes[s] += len((t or "").split())
        for r in got:
            words[r["source"]] += len(r["text"].split())
        target = _targets(dict(sizes))
        assert all(abs(words[s] - target[s]) <= 65 + max([len((t or "").split()) for _, t, x in rows if x == s]) for s in sizes)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "n_tokens"} <= set(out.columns)


def test_shingles_of_arrow_batches():
    """The stream that finds shared shingles gives the same counts however its rows are cut into batches."""
    rng = random.Random(9)
    rows = sorted({(rng.randrange(60), rng.choice([None, *range(8)])) for _ in range(250)}, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    groups = defaultdict(list)
    for s, c in rows:
        groups[s].append(c)
    want = Counter(c for cs in groups.values() if None in cs or len(set(cs)) > 1 for c in cs if c is not None)
    batch = pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.int64())], names=["shingle", "class_id"])
    for size in (1, 2, 7, 300):
        got = Counter()
        for b in jaccard._shared(iter([batch.slice(i, size) for i in range(0, len(rows), size)])):
            for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[c] += n
        assert got == want


def test_few_rows_make_few_files(spark):
    numbers = spark.range(300).withColumn("at", F.col("id") % 3).repartition(40, "id")
    assert len(written(numbers, "many").inputFiles()) > 30
    few = written(numbers, "few", rows=300)
    assert len(few.inputFiles()) == 1 and sorted(few.collect()) == sorted(numbers.collect())
    assert len(written(numbers, "none", rows=0).inputFiles()) == 1
    assert len(written(numbers, "large", rows=1 << 30).inputFiles()) > 30  # a bound is no call for more files


def test_rounds_of_components_make_few_files(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components_module, "written", lambda df, name, **options: made.append((name, written(df, name, **options))) or made[-1][1])
    monkeypatch.setattr(components_module, "drop_written", lambda df: None)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert {r["root"] for r in components(chain).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {len(df.inputFiles()) for name, df in made if name != "links"} == {1}


def test_neighbour_search_keeps_beams_only(spark, monkeypatch):
    """What a block of queries carries from step to step is bounded by its beams, whatever it has met."""
    sizes = []

    def told(df, name, **options):
        table = written(df, name, **options)
        if name == "beams":
            sizes.extend((sum(len(v) for v in r.asDict().values() if isinstance(v, bytearray | bytes)), len(r["queries"]) // 8) for r in table.collect())
        return table

    monkeypatch.setattr(ann, "written", told)
    x = np.random.default_rng(5).normal(size=(900, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.neighbours(table, F.col("vec_id") % 50 == 0, k=5, beam=30).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        sims = unit @ unit[q]
        sims[q] = -2
        hits += len(set(np.argsort(-sims)[:5].tolist()) & {r["vec_id"] for r in rows if r["query_id"] == q})
    assert hits >= 0.9 * len(rows) and len(rows) == 18 * 5
    assert sizes and all(n <= queries * (8 + 8 * 4 + 4 + 30 * (8 + 8 + 8 + 1)) for n, queries in sizes)


def test_neighbour_graph_grows_with_the_root(spark, monkeypatch):
    """The graph is over cells, stores and waves are bounded, every vector is in one store, and little is compared."""
    graphs, stored, beams, build, store, measured = [], [], [], ann.build_graph, ann.in_stores, ann.measured_beam

    def kept(*a):
        table = store(*a)
        stored.extend((np.frombuffer(r["ids"], "<i8").tolist(), r["store"]) for r in table.collect())
        return table

    monkeypatch.setattr(ann, "build_graph", lambda homes, dim, n, **options: graphs.append(n) or build(homes, dim, n, **options))
    monkeypatch.setattr(ann, "in_stores", kept, raising=False)
    monkeypatch.setattr(ann, "measured_beam", lambda *a: beams.append(measured(*a)) or beams[-1])
    for name, value in (("_LEAST_STORE", 60), ("_LEAST_WAVE", 10), ("_MOST_ASKING", 8)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(2500, 4)).astype(np.float32)
    x[700:1300] = x[3] + 1e-6 * rng.normal(size=(600, 4)).astype(np.float32)  # one cell, several stores
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].add((r["vec_id"], r["score"]))
    assert len(graphs) == 1 and graphs[0] <= 100
    ids = [i for own, _ in stored for i in own]
    distinct = len(np.unique(x, axis=0))
    assert len(ids) == len(set(ids)) == distinct and len(stored) > 20 and max(len(own) for own, _ in stored) <= 120
    assert beams and beams[0] < graphs[0] / 2
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2500, 20):
        s = y @ y[q]
        s[q] = -9
        assert len(got[q]) == 5 and all(abs(s[v] - c) < 1e-12 for v, c in got[q])
        hits += sum(c >= np.sort(s)[-5] - 1e-12 for _, c in got[q])
    assert hits >= 0.95 * 5 * 125, hits


def test_stores_and_nearest_by_groups():
    first, parts = ann.places(np.array([3, 5, 25, 0, 2, 9, 10]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5, 6] and parts.tolist() == [1, 1, 3, 1, 1, 1, 1]
    assert ann.cells_for(1) == 1 and ann.cells_for(2500) == 100 and ann.cells_for(10**9) == 16_384
    assert ann.store_size(64, 500) == 256 and ann.store_size(64, 10**8) == 1 << 17
    rng = np.random.default_rng(15)
    for n in (3, 11, 40, 333):
        q, y = rng.normal(size=(20, 8)), rng.normal(size=(n, 8))
        q, y = q / np.linalg.norm(q, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        true = q @ y.T
        worst = np.full(20, -3.0)
        i, j = ann._reaching(q.astype(np.float32) @ ann._filled(y.astype(np.float32), 6), n, worst, 6, 1e-6)
        best = np.argsort(-true, axis=1)[:, :6]
        assert {(a, b) for a in range(20) for b in best[a]} <= set(zip(i.tolist(), j.tolist(), strict=True))
        assert n < 6 or (worst <= np.sort(true, axis=1)[:, -6]).all()


def test_graph_links_hold_together():
    near = {i: [i ^ 1] for i in range(60)}  # pairs that know no others
    table = ann.links(near)
    assert all(i ^ 1 in table[i] for i in range(60))
    centres = np.random.default_rng(16).normal(size=(60, 6))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    order = ann.walked(centres[:7], np.arange(7), centres, table, 60)
    assert all(np.array_equal(o, np.argsort(-(centres @ centres[i]), kind="stable")) for i, o in enumerate(order))
