"""Recurrent reducers, gradients, orders and negatives against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import community, layers, message, sampling, temporal


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(8)
    pairs = sorted({(rng.randrange(30), 0 if rng.random() < 0.3 else rng.randrange(30)) for _ in range(150)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    x = {i: [rng.uniform(-1, 1) for _ in range(5)] for i in range(30)}
    return pairs, edges, x, spark.createDataFrame(list(x.items()), "id long, x array<double>")


def vectors(df):
    return {r["id"]: np.array(r["x"]) for r in df.collect()}


def sigmoid(v):
    return 1 / (1 + np.exp(-v))


@pytest.mark.parametrize("fan", [1, 4, 100])
def test_lstm_over_sampled_neighbours(small, fan):
    pairs, edges, x, xs = small
    cell = layers.Lstm(layers.weights(12, 5, 2), layers.weights(12, 3, 5), [0.1 * (i % 3) for i in range(12)])
    w, u, b = np.array(cell.w), np.array(cell.u), np.array(cell.b)
    into = defaultdict(list)
    for a, t in pairs:
        into[t].append(a)
    got = vectors(layers.lstm_reduce(edges, xs, cell, fan, 3))
    assert set(got) == set(into)
    for t, near in into.items():
        drawn = sorted(sorted(near, key=lambda a, t=t: ((t * 2654435761 + a * 40503 + 3) % 2147483629, a))[:fan])
        h, c = np.zeros(3), np.zeros(3)
        for a in drawn:
            z = w @ x[a] + u @ h + b
            i, f, g, o = sigmoid(z[:3]), sigmoid(z[3:6]), np.tanh(z[6:9]), sigmoid(z[9:])
            c = f * c + i * g
            h = o * np.tanh(c)
        assert np.allclose(got[t], h, atol=1e-12)


def test_sage_with_lstm_and_pool_layer(small):
    pairs, edges, x, xs = small
    cell = layers.Lstm(layers.weights(8, 5, 2), layers.weights(8, 2, 5), [0.0] * 8)
    near = vectors(layers.lstm_reduce(edges, xs, cell, 9))
    w, v = np.array(layers.weights(3, 5)), np.array(layers.weights(3, 2, 4))
    got = vectors(layers.sage(edges, xs, w.tolist(), v.tolist(), "lstm", lstm=cell, fan=9))
    assert all(np.allclose(got[i], w @ x[i] + v @ near.get(i, np.zeros(2))) for i in x)
    fc, bias = np.array(layers.weights(4, 5, 6)), [0.1, -0.2, 0.3, 0.0]
    k = np.array(layers.weights(3, 4, 1))
    pooled = vectors(layers.sage(edges, xs, w.tolist(), k.tolist(), "pool", pool=(fc.tolist(), bias), normalise=True))
    for i in x:
        into = [np.maximum(fc @ x[a] + bias, 0) for a, t in pairs if t == i]
        want = w @ x[i] + k @ (np.max(into, axis=0) if into else np.zeros(4))
        assert np.allclose(pooled[i], want / np.linalg.norm(want) if want.any() else want)


def test_softmax_of_far_apart_and_missing_scores(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, rng.choice([-900.0, -1.0, 0.5, 15.9, 16.1, 800.0]) + rng.random() if i % 3 else rng.uniform(-40, 40)) for i in range(300)] + [(999, 1, None), (998, 5, None)]
    got = {r["src"]: r["alpha"] for r in message.edge_softmax(spark.createDataFrame(rows, "src long, dst long, s double"), "s").collect()}
    for t in range(3):
        s = {i: v for i, d, v in rows if d == t and v is not None}
        e = {i: np.exp(v - max(s.values())) for i, v in s.items()}
        assert all(abs(got[i] - e[i] / sum(e.values())) < 1e-12 for i in s)
    assert got[999] is None and got[998] is None and len(got) == len(rows)


def gin_loss(pairs, x, w, grad):
    out = {i: np.zeros(len(x[i])) for i in x}
    for a, t in pairs:
        out[t] = out[t] + 0.5 * x[a]
    return sum(grad[i] @ (w @ out[i]) for i in x)


def test_gin_gradients_by_finite_differences(small, spark):
    pairs, edges, x, xs = small
    x = {i: np.array(v) for i, v in x.items()}
    w = np.array(layers.weights(2, 5, 3))
    grad = {i: np.array([np.sin(i), np.cos(i)]) for i in x}
    g = spark.createDataFrame([(i, v.tolist()) for i, v in grad.items()], "id long, x array<double>")
    by_w, by_x = layers.gin_grads(edges, xs, g, w.tolist())
    base, eps = gin_loss(pairs, x, w, grad), 1e-5
    for r in by_w.collect():
        moved = w.copy()
        moved[r["row"], r["col"]] += eps
        assert abs((gin_loss(pairs, x, moved, grad) - base) / eps - r["grad"]) < 1e-6
    got = vectors(by_x)
    for i in (0, 3, 17):
        for j in range(5):
            moved = x | {i: x[i] + eps * np.eye(5)[j]}
            assert abs((gin_loss(pairs, moved, w, grad) - base) / eps - got.get(i, np.zeros(5))[j]) < 1e-6
    weighted = message.gcn_weights(edges, xs)
    plain = {(r["src"], r["dst"]): r["w"] for r in weighted.collect()}
    want = sum(np.outer(grad[t], k * x[a]) for (a, t), k in plain.items())
    out = message.weight_grad(message.spmm(weighted, xs, 5, F.col("w")), g, 2, 5).collect()
    assert len(out) == 10 and all(abs(want[r["row"], r["col"]] - r["grad"]) < 1e-9 for r in out)


def test_gcn_norms(small):
    pairs, edges, x, xs = small
    o, i = defaultdict(int), defaultdict(int)
    for a, t in pairs:
        o[a] += 1
        i[t] += 1
    w = np.array(layers.weights(2, 5))
    for norm, k in {"left": lambda a, t: 1 / o[a], "none": lambda a, t: 1.0, "right": lambda a, t: 1 / i[t]}.items():
        got = vectors(layers.gcn(edges, xs, w.tolist(), norm))
        assert all(np.allclose(got[v], w @ sum((k(a, t) * np.array(x[a]) for a, t in pairs if t == v), np.zeros(5))) for v in x)


def walk(vertices, merges):
    kids, children, out = defaultdict(list), {m[0] for m in merges}, []
    for i, parent, round_, _ in merges:
        kids[parent].append((round_, i))
    for top in sorted(set(vertices) - children):
        stack = [top]
        while stack:
            v = stack.pop()
            out.append(v)
            stack += [i for _, i in sorted(kids[v], reverse=True)]
    return out


def test_order_of_a_deep_and_wide_forest(spark):
    rng = random.Random(2)
    ids = rng.sample(range(1000), 200)
    parent, size = {}, dict.fromkeys(ids, 1)
    for n, i in enumerate(ids[1:60], 1):
        parent[i] = ids[n - 1]  # a chain, whose end merged first
    for i in ids[60:150]:
        parent[i] = ids[0]  # many children of one
    depth = lambda i: 1 + depth(parent[i]) if i in parent else 0
    for i in sorted(parent, key=depth, reverse=True):
        size[parent[i]] += size[i]
    merges = [(i, p, 100 - depth(i), size[i]) for i, p in parent.items()]
    vertices = spark.createDataFrame([(i,) for i in ids], "id long")
    forest = spark.createDataFrame(merges, "id long, parent long, round int, size long")
    got = {r["id"]: r["new"] for r in community.order_by_forest(vertices, forest).collect()}
    assert got == {v: n for n, v in enumerate(walk(ids, merges))}
    none = community.order_by_forest(vertices, forest.limit(0)).collect()
    assert {r["id"]: r["new"] for r in none} == {v: n for n, v in enumerate(sorted(ids))}


def test_forest_of_cliques_keeps_them_together(spark):
    cliques = [(base + i, base + j, 1) for base in (0, 10, 20) for i in range(6) for j in range(i)] + [(0, 10, 1), (10, 20, 1)]
    edges = spark.createDataFrame(cliques, "src long, dst long, w long")
    vertices = spark.createDataFrame([(b + i,) for b in (0, 10, 20) for i in range(6)], "id long")
    labels, forest = community.merge_forest(edges, vertices)
    merges = [tuple(r) for r in forest.select("id", "parent", "round", "size").collect()]
    got = {r["id"]: r["new"] for r in community.order_by_forest(vertices, forest).collect()}
    assert got == {v: n for n, v in enumerate(walk([r["id"] for r in vertices.collect()], merges))}
    for r in labels.collect():
        members = sorted(got[x["id"]] for x in labels.where(F.col("community") == r["community"]).collect())
        assert members == list(range(members[0], members[0] + 6))


def test_unseen_negatives(spark):
    rows = [(i, i % 4, 10 + i % 3, i, "train") for i in range(20)] + [(20 + i, i % 6, 10 + i % 5, 20 + i, "test") for i in range(40)]
    split = spark.createDataFrame(rows, "eid long, src long, dst long, ts long, split string")
    assert {r["id"] for r in sampling.unseen_nodes(split).collect()} == {4, 5, 13, 14}
    got = sampling.negatives_among(split.where("split = 'test'"), sampling.unseen_nodes(split), 3, 5).collect()
    pool = [4, 5, 13, 14]
    assert len(got) == 120 and all(r["neg"] == pool[(r["eid"] * 2654435761 + r["j"] * 40503 + 5) % 2147483629 % 4] for r in got)
    assert sampling.negatives_among(split, sampling.unseen_nodes(split).limit(0), 2).count() == 0
    assert temporal.inductive(split).count() >= 20
