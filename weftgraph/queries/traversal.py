from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import traverse
from weftgraph.operators.components import connected_components
from weftgraph.queries import query
from weftgraph.sources.graphs import PART_GRAPH, part_graph, part_vertices

V = "SELECT p_partkey AS id FROM part"


def _walk(start: str, new: str, best: str, better: str) -> str:
    return f"""WITH RECURSIVE {PART_GRAPH},
t(v, d) USING KEY (v) AS ({start} UNION
  SELECT x.v, x.d FROM (SELECT e.dst AS v, {best}({new}) AS d FROM t JOIN e ON e.src = t.v GROUP BY e.dst) x
  LEFT JOIN recurring.t r ON r.v = x.v WHERE r.v IS NULL OR x.d {better} r.d)"""


SOURCE = "SELECT CAST(0 AS BIGINT), CAST({} AS BIGINT)"
REACHED = f"SELECT p.id, CAST(coalesce(t.d, {{}}) AS BIGINT) AS value FROM ({V}) p LEFT JOIN t ON t.v = p.id"
BFS = _walk(SOURCE.format(0), "t.d + 1", "min", "<")


@query("g1_bfs", f"{BFS} {REACHED.format(traverse.FAR)}")
def g1_bfs(spark, sf_dir):
    return traverse.with_unreached(traverse.bfs(part_graph(spark, sf_dir), 0), part_vertices(spark, sf_dir))


@query("g2_sssp", f"{_walk(SOURCE.format(0), 't.d + e.w', 'min', '<')} {REACHED.format(traverse.FAR)}")
def g2_sssp(spark, sf_dir):
    return traverse.with_unreached(traverse.sssp(part_graph(spark, sf_dir), 0), part_vertices(spark, sf_dir))


@query("g3_sswp", f"{_walk(SOURCE.format(traverse.FAR), 'least(t.d, e.w)', 'max', '>')} {REACHED.format(0)}")
def g3_sswp(spark, sf_dir):
    return traverse.with_unreached(traverse.sswp(part_graph(spark, sf_dir), 0), part_vertices(spark, sf_dir), 0)


@query("g4_min_labels", f"{_walk('SELECT p_partkey, p_partkey FROM part', 't.d', 'min', '<')} SELECT v AS id, d AS value FROM t")
def g4_min_labels(spark, sf_dir):
    return traverse.min_labels(part_graph(spark, sf_dir), part_vertices(spark, sf_dir))


@query("g4_components", f"""WITH RECURSIVE {PART_GRAPH}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
t(v, d) USING KEY (v) AS (SELECT src, min(src) FROM b GROUP BY src UNION
  SELECT x.v, x.d FROM (SELECT b.dst AS v, min(t.d) AS d FROM t JOIN b ON b.src = t.v GROUP BY b.dst) x
  LEFT JOIN recurring.t r ON r.v = x.v WHERE r.v IS NULL OR x.d < r.d)
SELECT v AS id, d AS component FROM t""")
def g4_components(spark, sf_dir):
    return connected_components(part_graph(spark, sf_dir))


def _pagerank_sql(rounds: int) -> str:
    parts = [PART_GRAPH, "g AS (SELECT src, count(*) AS n FROM e GROUP BY src)", "s0 AS (SELECT p_partkey AS id, 0.0::DOUBLE AS value, 0.15::DOUBLE AS delta FROM part)"]
    for i in range(rounds):
        parts.append(f"""s{i + 1} AS MATERIALIZED (SELECT s.id, s.value + CASE WHEN delta > 0.01 THEN delta ELSE 0 END AS value,
  s.delta - CASE WHEN delta > 0.01 THEN delta ELSE 0 END + coalesce(m.got, 0) AS delta FROM s{i} s LEFT JOIN
  (SELECT e.dst, sum(0.85::DOUBLE * a.delta / g.n) AS got FROM s{i} a JOIN e ON e.src = a.id JOIN g ON g.src = a.id WHERE a.delta > 0.01 GROUP BY e.dst) m ON m.dst = s.id)""")
    return f"WITH {', '.join(parts)} SELECT id, round(value, 6) AS value FROM s{rounds}"


@query("g5_pagerank_rounds", _pagerank_sql(8))
def g5_pagerank_rounds(spark, sf_dir):
    """The first eight rounds, which SQL can unroll."""
    return traverse.pagerank(part_graph(spark, sf_dir), part_vertices(spark, sf_dir), rounds=8).select("id", F.round("value", 6).alias("value"))


@query("g5_pagerank")
def g5_pagerank(spark, sf_dir):
    return traverse.pagerank(part_graph(spark, sf_dir), part_vertices(spark, sf_dir)).select("id", F.round("value", 6).alias("value"))


def _betweenness_sql(deepest: int) -> str:
    parts = [BFS, "x AS (SELECT e.src, e.dst, a.d FROM e JOIN t a ON a.v = e.src JOIN t b ON b.v = e.dst WHERE b.d = a.d + 1)", "p0 AS (SELECT CAST(0 AS BIGINT) AS v, CAST(1 AS BIGINT) AS n)"]
    parts += [f"p{i + 1} AS MATERIALIZED (SELECT x.dst AS v, CAST(sum(p.n) AS BIGINT) AS n FROM x JOIN p{i} p ON p.v = x.src WHERE x.d = {i} GROUP BY x.dst)" for i in range(deepest)]
    parts.append(f"b{deepest} AS (SELECT v, n, 0.0::DOUBLE AS b FROM p{deepest})")
    parts += [f"""b{i} AS MATERIALIZED (SELECT p.v, p.n, p.n * coalesce(m.s, 0.0::DOUBLE) AS b FROM p{i} p LEFT JOIN
  (SELECT x.src, sum((1 + b.b) / b.n) AS s FROM x JOIN b{i + 1} b ON b.v = x.dst WHERE x.d = {i} GROUP BY x.src) m ON m.src = p.v)""" for i in range(deepest - 1, -1, -1)]
    union = " UNION ALL ".join(f"SELECT v AS id, CAST({i} AS BIGINT) AS level, n AS paths, round(b, 6) AS value FROM b{i}" for i in range(deepest + 1))
    return f"{', '.join(parts)} {union}"


@query("g7_betweenness", _betweenness_sql(24))
def g7_betweenness(spark, sf_dir):
    return traverse.betweenness(part_graph(spark, sf_dir), 0).withColumn("value", F.round("value", 6))


@query("g9_farthest", f"{BFS} SELECT max(d) AS farthest, count(*) AS reached FROM t")
def g9_farthest(spark, sf_dir):
    return traverse.farthest(traverse.bfs(part_graph(spark, sf_dir), 0))
