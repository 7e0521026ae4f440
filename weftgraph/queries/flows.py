from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import vectors as vec
from weftgraph.operators import flows, layers
from weftgraph.queries import query
from weftgraph.queries.messages import DIM, FULL, G, _dense, _graph, _out

HIDDEN, CLASSES = 4, 3
BIAS, LAST = [0.1 * (i - 1) for i in range(HIDDEN)], [0.05 * i for i in range(CLASSES)]
SKIP = flows.Step(layers.weights(HIDDEN, DIM, 1), BIAS, vec.relu, skip=True)
OUT = flows.Step(layers.weights(CLASSES, 2 * HIDDEN, 2), LAST)
FANS = [3, 2]


def _drawn(salt: int, fan: int, of: str = "w") -> str:
    return f"SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY (dst * 2654435761 + src * 40503 + {salt}) % 2147483629, src) AS n FROM {of}) WHERE n <= {fan}"


def _stepped(of: str, step: flows.Step) -> str:
    return f"SELECT id, pos, v + ([{', '.join(map(str, step.bias))}]::DOUBLE[])[pos + 1] AS v FROM {_dense(of, step.w)}"


def _mean(edges: str, of: str) -> str:
    return f"SELECT dst AS id, pos, avg(v) AS v FROM {edges} JOIN {of} h ON h.id = src GROUP BY dst, pos"


def _all(nodes: str, of: str, dim: int) -> str:
    return f"SELECT p.id, k.pos, coalesce(a.v, 0.0) AS v FROM {nodes} p CROSS JOIN (SELECT unnest(range({dim})) AS pos) k LEFT JOIN {of} a ON a.id = p.id AND a.pos = k.pos"


SKIPPED = f"h AS ({_stepped('z', SKIP)}), c AS (SELECT id, pos, v FROM h UNION ALL SELECT id, pos + {HIDDEN}, greatest(v, 0.0) FROM h)"
NODES = "q AS (SELECT id FROM pf WHERE pos = 0)"
FLOW = f"s0 AS ({_drawn(5, FANS[0])}), n1 AS (SELECT DISTINCT src AS id FROM s0), w1 AS (SELECT src, dst FROM w WHERE dst IN (SELECT id FROM n1)), s1 AS ({_drawn(6, FANS[1], 'w1')})"
LAST_SQL = f"y AS ({_all('q', 'g', 2 * HIDDEN)}) SELECT id, pos, round(v, 6) AS val FROM ({_stepped('y', OUT)})"


@query("l6_sampled_gcn", f"{G}, {NODES}, {FLOW}, a AS ({_mean('s1', 'pf')}), z AS ({_all('n1', 'a', DIM)}), {SKIPPED}, g AS ({_mean('s0', 'c')}), {LAST_SQL}")
def l6(spark, d):
    """Two sampled layers of all parts, the hidden one with a skip connection."""
    e, x = _graph(spark, d)
    return _out(flows.sampled_gcn(flows.node_flow(e, x, FANS, 5), x, [SKIP, OUT]))


@query("l6_full_gcn", f"{G}, {NODES}, a AS ({_mean('w', 'pf')}), z AS ({FULL}), {SKIPPED}, g AS ({_mean('w', 'c')}), {LAST_SQL}")
def l6_full(spark, d):
    """The same layers over all neighbours: sums times the nodes' norms."""
    e, x = _graph(spark, d)
    return _out(flows.full_gcn(e, x, [SKIP, OUT]))


@query("l7_history_gcn", f"""{G}, {NODES}, {FLOW}, o0 AS (SELECT id, pos, 0.75 * v AS v FROM pf), d0 AS (SELECT id, pos, 0.25 * v AS v FROM pf), a0 AS ({_mean('s1', 'd0')}), b0 AS ({_mean('w1', 'o0')}),
e0 AS ({_all('n1', 'a0', DIM)}), f0 AS ({_all('n1', 'b0', DIM)}), z AS (SELECT e0.id, e0.pos, e0.v + f0.v AS v FROM e0 JOIN f0 ON f0.id = e0.id AND f0.pos = e0.pos), {SKIPPED},
o1 AS (SELECT id, pos, 0.5 * v AS v FROM pf WHERE pos < {2 * HIDDEN}), d1 AS (SELECT c.id, c.pos, c.v - o1.v AS v FROM c JOIN o1 ON o1.id = c.id AND o1.pos = c.pos), a1 AS ({_mean('s0', 'd1')}), b1 AS ({_mean('w', 'o1')}),
e1 AS ({_all('q', 'a1', 2 * HIDDEN)}), f1 AS ({_all('q', 'b1', 2 * HIDDEN)}), y AS (SELECT e1.id, e1.pos, e1.v + f1.v AS v FROM e1 JOIN f1 ON f1.id = e1.id AND f1.pos = e1.pos)
SELECT id, pos, round(v, 6) AS val FROM ({_stepped('y', OUT)})""")
def l7_history(spark, d):
    """The sampled layers with control variates: histories are three quarters of the features, and half of their first numbers."""
    e, x = _graph(spark, d)
    old = [x.select("id", vec.scale(F.col("x"), F.lit(0.75)).alias("x")), x.select("id", vec.scale(F.slice("x", 1, 2 * HIDDEN), F.lit(0.5)).alias("x"))]
    return _out(flows.history_gcn(flows.node_flow(e, x, FANS, 5), e, x, old, [SKIP, OUT])[0])


def _normed(of: str) -> str:
    return f"SELECT id, t.pos, greatest((v - m) / sqrt(s + 1e-5), 0.0) AS v FROM {of} t JOIN (SELECT pos, avg(v) AS m, var_pop(v) AS s FROM {of} GROUP BY pos) k ON k.pos = t.pos"


GIN = [flows.Step(layers.weights(HIDDEN, DIM, 3), BIAS), flows.Step(layers.weights(CLASSES, HIDDEN, 4), LAST)]


@query("l8_gin_batch_norm", f"{G}, a AS ({_mean('w', 'pf')}), z AS (SELECT p.id, p.pos, 1.1 * p.v + coalesce(a.v, 0.0) AS v FROM pf p LEFT JOIN a ON a.id = p.id AND a.pos = p.pos), h AS ({_stepped('z', GIN[0])}), n AS ({_normed('h')}), g AS ({_stepped('n', GIN[1])}) SELECT id, pos, round(v, 6) AS val FROM ({_normed('g')})")
def l8_batch(spark, d):
    e, x = _graph(spark, d)
    return _out(flows.gin_batch(e, x, *GIN, eps=0.1))
