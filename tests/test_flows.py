"""Layers over node flows against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import vectors as vec
from weftgraph.operators import flows, layers

N, DIM = 40, 5
BEFORE = flows.Step(layers.weights(4, DIM, 3), [0.1, 0.0, -0.2, 0.3], vec.relu)
SKIP = flows.Step(layers.weights(3, 4, 1), [0.2, -0.1, 0.0], vec.relu, skip=True)
OUT = flows.Step(layers.weights(2, 6, 2), [0.5, -0.5])


@pytest.fixture(scope="module")
def graph(spark):
    """A third of all edges go into node 0, and node 39 has no in-neighbour."""
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(N), 0 if rng.random() < 0.33 else rng.randrange(N - 1)) for _ in range(220)})
    x = {i: np.array([rng.uniform(-1, 1) for _ in range(DIM)]) for i in range(N)}
    return pairs, x, spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, x array<double>")


def vectors(df):
    rows = df.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: np.array(r["x"]) for r in rows}


def plain_step(step, v):
    out = np.array(step.w) @ v + (0 if step.bias is None else np.array(step.bias))
    if step.activation is None:
        return out
    return np.concatenate([out, np.maximum(out, 0)]) if step.skip else np.maximum(out, 0)


def plain_flow(pairs, seeds, fans, salt, loops):
    nodes, out = set(seeds), []
    for depth, fan in enumerate(fans):
        met = []
        for t in nodes:
            near = sorted((a for a, b in pairs if b == t), key=lambda a, t=t: ((t * 2654435761 + a * 40503 + salt + depth) % 2147483629, a))[:fan]
            met += [(a, t) for a in near] + ([(t, t)] if loops else [])
        out.append((met, nodes))
        nodes = {a for a, _ in met}
    return out[::-1]


def mean_into(edges, nodes, h, dim):
    found = {t: [h[a] for a, b in edges if b == t] for t in nodes}
    return {t: np.mean(v, axis=0) if v else np.zeros(dim) for t, v in found.items()}


@pytest.mark.parametrize("loops", [False, True])
def test_flow_and_sampled_layers(spark, graph, loops):
    pairs, x, edges, xs = graph
    seeds = [0, 3, 17, 39, 3]
    flow = flows.node_flow(edges, spark.createDataFrame([(s,) for s in seeds], "id long"), [2, 3], 7, loops)
    want = plain_flow(pairs, seeds, [2, 3], 7, loops)
    for block, (met, nodes) in zip(flow, want, strict=True):
        assert sorted(map(tuple, block.edges.select("src", "dst").collect())) == sorted(met)
        assert {r["id"] for r in block.nodes.collect()} == nodes
    h = {i: plain_step(BEFORE, v) for i, v in x.items()}
    for (met, nodes), step in zip(want, [SKIP, OUT]):
        h = {i: plain_step(step, v) for i, v in mean_into(met, nodes, h, step.inputs).items()}
    got = vectors(flows.sampled_gcn(flow, xs, [SKIP, OUT], BEFORE))
    assert set(got) == set(seeds) and all(np.allclose(got[i], h[i]) for i in h)


def plain_full(pairs, x, norms=None):
    inputs, h = [], {i: plain_step(BEFORE, v) for i, v in x.items()}
    for step in (SKIP, OUT):
        inputs.append(h)
        m = mean_into(pairs, range(N), h, step.inputs)
        if norms:
            m = {t: v * sum(b == t for _, b in pairs) * norms[t] for t, v in m.items()}
        h = {i: plain_step(step, v) for i, v in m.items()}
    return h, inputs


def test_full_layers(spark, graph):
    pairs, x, edges, xs = graph
    got, (want, _) = vectors(flows.full_gcn(edges, xs, [SKIP, OUT], before=BEFORE)), plain_full(pairs, x)
    assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)
    norms = {i: 0.1 + i / 100 for i in range(N)}
    got, (want, _) = vectors(flows.full_gcn(edges, xs, [SKIP, OUT], spark.createDataFrame(list(norms.items()), "id long, norm double"), BEFORE)), plain_full(pairs, x, norms)
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_histories(spark, graph):
    """Without histories the layers are the sampled ones, with those of the full layers they are the
    full ones whatever was drawn, and what is kept is what the flow's nodes had."""
    pairs, x, edges, xs = graph
    seeds = spark.createDataFrame([(0,), (5,), (39,), (11,)], "id long")
    flow = flows.node_flow(edges, seeds, [2, 2], 1)
    steps, none = [SKIP, OUT], spark.createDataFrame([], "id long, x array<double>")
    got, kept = flows.history_gcn(flow, edges, xs, [none, none], steps, BEFORE)
    plain = vectors(flows.sampled_gcn(flow, xs, steps, BEFORE))
    got = vectors(got)
    assert set(got) == set(plain) and all(np.allclose(got[i], plain[i]) for i in plain)
    want, inputs = plain_full(pairs, x)
    for block, mine, whole in zip(flow, kept, [inputs[0], None]):
        mine = vectors(mine)
        assert set(mine) == {r["src"] for r in block.edges.collect()}
        assert whole is None or all(np.allclose(mine[i], whole[i]) for i in mine)
    old = [spark.createDataFrame([(i, v.tolist()) for i, v in h.items()], "id long, x array<double>") for h in inputs]
    got, kept = flows.history_gcn(flow, edges, xs, old, steps, BEFORE)
    got = vectors(got)
    assert all(np.allclose(got[i], want[i]) for i in got)
    assert all(len(vectors(k)) == N for k in kept)


def test_batch_norm_and_gin(graph):
    pairs, x, edges, xs = graph
    gamma, beta = [1.0, 2.0, 0.5, 1.0, 1.0], [0.0, 1.0, 0.0, -1.0, 0.5]
    got = vectors(flows.batch_norm(xs, flows.batch_stats(xs, DIM), gamma, beta))
    m = np.stack([x[i] for i in range(N)])
    want = (m - m.mean(axis=0)) / np.sqrt(m.var(axis=0) + 1e-5) * gamma + beta
    assert all(np.allclose(got[i], want[i]) for i in range(N))
    part = flows.batch_norm(xs.where("id < 5"), flows.batch_stats(xs, DIM))
    assert np.allclose(vectors(part)[4], ((m - m.mean(axis=0)) / np.sqrt(m.var(axis=0) + 1e-5))[4])
    first, second = flows.Step(layers.weights(3, DIM, 3), [0.1, 0.2, 0.3]), flows.Step(layers.weights(2, 3, 4))
    got, near = vectors(flows.gin_batch(edges, xs, first, second, 0.2)), mean_into(pairs, range(N), x, DIM)
    h = np.stack([1.2 * x[i] + near[i] for i in range(N)])
    for step in (first, second):
        h = h @ np.array(step.w).T + (0 if step.bias is None else np.array(step.bias))
        h = np.maximum((h - h.mean(axis=0)) / np.sqrt(h.var(axis=0) + 1e-5), 0)
    assert all(np.allclose(got[i], h[i]) for i in range(N))


def test_no_rows(spark, graph):
    _, _, edges, xs = graph
    flow = flows.node_flow(edges, spark.createDataFrame([], "id long"), [2, 2])
    assert flows.sampled_gcn(flow, xs, [SKIP, OUT], BEFORE).count() == 0
    assert flows.gin_batch(edges.where("false"), xs.where("false"), flows.Step(layers.weights(3, DIM)), flows.Step(layers.weights(2, 3))).count() == 0
    alone = vectors(flows.full_gcn(edges.where("false"), xs.select("id", F.col("x")), [SKIP, OUT], before=BEFORE))
    assert len(alone) == N and all(np.allclose(v, plain_step(OUT, np.zeros(6))) for v in alone.values())
