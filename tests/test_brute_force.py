"""Queries that SQL can't express, and iterative ones, against plain Python over the same tables."""

from collections import Counter, defaultdict

import numpy as np

from weftgraph.catalog import QUERIES
from weftgraph.functions import vectors
from weftgraph.operators import community, layers, memory
from weftgraph.plans.lineage import cut
from weftgraph.queries import temporals
from weftgraph.sources.generated import uniform_graph
from weftgraph.sources.graphs import KINDS, event_graph, features, part_graph, part_vertices


def long(df, *key):
    """{key: vector} of rows (key..., pos, val)."""
    out = defaultdict(dict)
    for r in df.collect():
        out[tuple(r[k] for k in key)][r["pos"]] = r["val"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def normal(v):
    return (v - v.mean()) / np.sqrt(v.var() + 1e-5)


def leaky(x):
    return np.where(x < 0, 0.2 * x, x)


def encoded(t, dim):
    return np.cos(t * np.array([10 ** (-9 * j / max(1, dim - 1)) for j in range(dim)]))


def attended(q, ks, vs, heads):
    d, out = len(q) // heads, []
    for h in range(heads):
        part = slice(h * d, (h + 1) * d)
        s = np.array([leaky(q[part] @ k[part]) for k in ks])
        a = np.exp(s - s.max())
        out.append(sum(w * v[part] for w, v in zip(a / a.sum(), vs)))
    return np.concatenate(out)


def test_pagerank_runs_to_its_end(spark, sf_dir):
    e = [(r["src"], r["dst"]) for r in part_graph(spark, sf_dir).collect()]
    out = Counter(a for a, _ in e)
    delta = {r["id"]: 0.15 for r in part_vertices(spark, sf_dir).collect()}
    value = dict.fromkeys(delta, 0.0)
    while any(v > 0.01 for v in delta.values()):
        sent = {i: v for i, v in delta.items() if v > 0.01}
        got = Counter()
        for a, b in e:
            if a in sent:
                got[b] += 0.85 * sent[a] / out[a]
        for i, v in sent.items():
            value[i] += v
            delta[i] = 0.0
        for i, v in got.items():
            delta[i] += v
    rows = QUERIES["g5_pagerank"](spark, sf_dir).collect()
    assert {r["id"] for r in rows} == set(value) and all(abs(r["value"] - value[r["id"]]) < 1e-5 for r in rows)


def weigh(edges, label):
    """Strengths of communities, weights between two of them (both directions), and all weights."""
    strength, between = Counter(), Counter()
    for r in edges:
        a, b = label[r["src"]], label[r["dst"]]
        strength[a] += r["w"]
        strength[b] += r["w"]
        between[min(a, b), max(a, b)] += r["w"]
    return strength, between, sum(strength.values())


def test_no_merge_of_communities_gains_and_order_follows_them(spark, sf_dir):
    labels = cut(QUERIES["g10_communities"](spark, sf_dir))
    label = {r["id"]: r["community"] for r in labels.collect()}
    edges = part_graph(spark, sf_dir).collect()
    strength, between, m2 = weigh(edges, label)
    assert all(w * m2 <= strength[a] * strength[b] * (1 + 1e-12) for (a, b), w in between.items() if a != b)
    quality = sum(2 * between[c, c] / m2 - (s / m2) ** 2 for c, s in strength.items())
    assert quality > 0.2 and all(label[c] == c for c in label.values())
    assert set(label) == {r["id"] for r in part_vertices(spark, sf_dir).collect()}
    place = {i: n for n, i in enumerate(sorted(label, key=lambda i: (label[i], i)))}
    got = Counter((r["src"], r["dst"], r["w"]) for r in community.reorder(part_graph(spark, sf_dir), community.order_by_community(labels)).select("src", "dst", "w").collect())
    assert got == Counter((place[r["src"]], place[r["dst"]], r["w"]) for r in edges)


def test_cliques_and_a_star_are_communities(spark):
    cliques = [(base + i, base + j, 1) for base in (0, 10, 20) for i in range(6) for j in range(i)] + [(0, 10, 1), (10, 20, 1)]
    star = [(100, i, 1) for i in range(101, 161)]
    edges = spark.createDataFrame(cliques + star, "src long, dst long, w long")
    vertices = edges.select("src").union(edges.select("dst")).distinct().withColumnRenamed("src", "id").union(spark.range(900, 901))
    found = defaultdict(set)
    for r in community.merge_communities(edges, vertices).collect():
        found[r["community"]].add(r["id"])
    assert {900} in found.values()
    assert all({base + i for i in range(6)} in found.values() for base in (0, 10, 20))
    strength, between, m2 = weigh(edges.collect(), {i: c for c, ids in found.items() for i in ids})
    assert all(w * m2 <= strength[a] * strength[b] for (a, b), w in between.items() if a != b)


def before(events, k, width=None, shift=0):
    """Of each event the k latest of the same source before it, moved back by shift, latest first."""
    by = defaultdict(list)
    for e in sorted(events, key=lambda e: (e["ts"], e["eid"])):
        by[e["src"]].append(e)
    out = {}
    for r in events:
        at = r["ts"] - shift
        out[r["eid"]] = [e for e in by[r["src"]] if e["ts"] < at and (width is None or at - e["ts"] < width)][::-1][:k]
    return out


def test_temporal_attention(spark, sf_dir):
    events = event_graph(spark, sf_dir).collect()
    x = {r["id"]: np.array(r["x"]) for r in features(spark, sf_dir).collect()}
    dim = len(x[0])
    w_q, w_k, w_v, w_out = map(np.array, temporals.attention_weights(dim))
    got = long(QUERIES["l11_temporal_attention"](spark, sf_dir), "root_id")
    near = before(events, 3)
    assert len(got) == len(events)
    for r in events:
        own = x[r["src"] % len(x)]
        rows = [np.concatenate([x[e["dst"] - KINDS], [e["w"]], encoded((r["ts"] - e["ts"]) * 1e-12, temporals.TIME)]) for e in near[r["eid"]]]
        q = w_q @ np.concatenate([own, encoded(0, temporals.TIME)])
        a = attended(q, [w_k @ v for v in rows], [w_v @ v for v in rows], temporals.HEADS) if rows else np.zeros(4)
        want = normal(np.maximum(w_out @ np.concatenate([a, own]), 0))
        assert np.allclose(got[r["eid"],], want, atol=2e-5)


def test_snapshot_state(spark, sf_dir):
    events = event_graph(spark, sf_dir).collect()
    x = {r["id"]: np.array(r["x"]) for r in features(spark, sf_dir).collect()}
    dim = len(x[0])
    w, u = np.array(layers.weights(4, dim)), np.array(layers.weights(4, 4, 2))
    got = long(QUERIES["l12_snapshot_state"](spark, sf_dir), "root_id")
    windows = [before(events, 2, 7 * temporals.DAY, i * 7 * temporals.DAY) for i in range(3)]
    for r in events:
        near = [win[r["eid"]] for win in windows]
        if not any(near):
            assert (r["eid"],) not in got
            continue
        h = np.zeros(4)
        for some in near[::-1]:
            h = np.tanh(w @ (np.mean([x[e["dst"] - KINDS] for e in some], axis=0) if some else np.zeros(dim)) + u @ h)
        assert np.allclose(got[r["eid"],], h, atol=2e-6)


def test_recurrent_memory(spark, sf_dir):
    graph = event_graph(spark, sf_dir)
    events = sorted(graph.collect(), key=lambda e: (e["ts"], e["eid"]))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for kind, size in (("gru", len(events) // 26), ("rnn", 600)):
        c, d = temporals.cell(kind), temporals.CELL_DIM
        w, u, state = np.array(c.w), np.array(c.u), {}
        for at in range(0, len(events), size):
            mail = {}
            for e in events[at : at + size]:
                a, b = e["src"], e["dst"]
                mail[a], mail[b] = (b, e), (a, e)
            new = {}
            for node, (peer, e) in mail.items():
                h, was = state.get(node, (np.zeros(d), 0))
                m = np.concatenate([h, state.get(peer, (np.zeros(d), 0))[0], [e["w"] / 100], encoded((e["ts"] - was) * c.scale, c.time_dim)])
                p, q = w @ m, u @ h
                if kind == "rnn":
                    new[node] = np.tanh(p + q), e["ts"]
                else:
                    r, z = sigmoid(p[:d] + q[:d]), sigmoid(p[d : 2 * d] + q[d : 2 * d])
                    new[node] = (1 - z) * np.tanh(p[2 * d :] + r * q[2 * d :]) + z * h, e["ts"]
            state |= new
        rows = QUERIES["st7_rnn_memory"](spark, sf_dir) if kind == "rnn" else vectors.long_form(memory.evolve(temporals._featured(graph), size, c), ["node", "memory_ts"], "memory")
        got = long(rows, "node", "memory_ts")
        assert set(got) == {(n, ts) for n, (_, ts) in state.items()}
        assert all(np.allclose(v, state[n][0], atol=2e-6) for (n, _), v in got.items())


def test_mailbox_attention(spark, sf_dir):
    boxes = defaultdict(list)
    for e in sorted(event_graph(spark, sf_dir).collect(), key=lambda e: (e["ts"], e["eid"])):
        boxes[e["src"]].append(e)
        boxes[e["dst"]].append(e)
    w_q, w_k, w_v, w_out = (np.array(layers.weights(4, *a)) for a in ((4,), (3, 2), (3, 5), (4, 3)))
    got = long(QUERIES["st8_mailbox_attention"](spark, sf_dir), "node")
    assert set(got) == {(n,) for n in boxes}
    assert sum(len(b) for n, b in boxes.items() if n >= KINDS) * 2 == sum(map(len, boxes.values()))  # the hubs
    for node, mails in boxes.items():
        h = np.array([((node + i) % 7 - 3) / 3.0 for i in range(4)])
        rows = [np.concatenate([[e["w"] / 100], encoded(e["ts"] * 1e-12, 2)]) for e in mails[-4:]]
        a = attended(w_q @ h, [w_k @ v for v in rows], [w_v @ v for v in rows], 2)
        assert np.allclose(got[node,], np.maximum(w_out @ normal(h + a), 0), atol=2e-6)


def test_generated_graph(spark):
    g = uniform_graph(spark, 50, 1000).collect()
    assert len(g) == 1000 and {r["src"] for r in g} == {r["dst"] for r in g} == set(range(50))
