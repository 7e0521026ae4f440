from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import metrics
from weftgraph.functions import vectors as vec
from weftgraph.operators import community, layers, message
from weftgraph.plans.lineage import stored
from weftgraph.queries import query
from weftgraph.sources.graphs import PART_FEATURES, PART_GRAPH, SUPPLY_GRAPH, part_features, part_graph, part_steps, part_vectors, part_vertices, supplies, supply_graph, table

DIM = 64  # numbers of a vector
G = f"WITH {PART_GRAPH}, {PART_FEATURES}, w AS (SELECT src, dst, w / 50.0::DOUBLE AS w FROM e)"


def _graph(spark, d):
    return part_graph(spark, d).withColumn("w", F.col("w") / F.lit(50.0)), part_features(spark, d)


def _out(x, key=("id",)):
    return vec.long_form(x, list(key), "x")


def _sum(expr: str, of: str = "w") -> str:
    return f"SELECT dst AS id, pos, round({expr}, 6) AS val FROM {of} JOIN pf ON pf.id = src GROUP BY dst, pos"


@query("m1_copy_u", f"{G} SELECT src, dst, pos, round(v, 6) AS val FROM w JOIN pf ON pf.id = src")
def m1(spark, d):
    e, x = _graph(spark, d)
    return _out(message.copy_u(e, x), ("src", "dst"))


@query("m2_u_add_v", f"{G}, a AS MATERIALIZED (SELECT id, v FROM pf WHERE pos = 0), b AS MATERIALIZED (SELECT id, v FROM pf WHERE pos = 1) SELECT src, dst, round(a.v + b.v, 6) AS e FROM w JOIN a ON a.id = src JOIN b ON b.id = dst")
def m2(spark, d):
    e, x = _graph(spark, d)
    return message.u_add_v(e, x.select("id", F.col("x")[0].alias("value")), x.select("id", F.col("x")[1].alias("value"))).select("src", "dst", F.round("e", 6).alias("e"))


@query("m3_u_mul_e", f"{G} SELECT src, dst, pos, round(v * w, 6) AS val FROM w JOIN pf ON pf.id = src")
def m3(spark, d):
    e, x = _graph(spark, d)
    return _out(message.u_mul_e(e, x, F.col("w")), ("src", "dst"))


@query("m4_edge_softmax", f"{G} SELECT src, dst, round(exp(w) / sum(exp(w)) OVER (PARTITION BY dst), 6) AS alpha FROM w")
def m4(spark, d):
    return message.edge_softmax(_graph(spark, d)[0], "w").select("src", "dst", F.round("alpha", 6).alias("alpha"))


@query("m7_spmm", f"{G} {_sum('sum(v * w)')}")
def m7(spark, d):
    return _out(message.spmm(*_graph(spark, d), DIM, F.col("w")))


@query("m13_scatter_gather", f"{G} SELECT src AS id, pos, round(sum(v), 6) AS val FROM w JOIN pf ON pf.id = dst GROUP BY src, pos")
def m13(spark, d):
    e, x = _graph(spark, d)
    return _out(message.spmm(e.withColumns({"src": F.col("dst"), "dst": F.col("src")}), x, DIM))


@query("m16_reduce_mean", f"{G} {_sum('avg(v)')}")
def m16_mean(spark, d):
    return _out(message.spmm(*_graph(spark, d), DIM, how="mean"))


@query("m16_reduce_max", f"{G} {_sum('max(v)')}")
def m16_max(spark, d):
    return _out(message.spmm(*_graph(spark, d), DIM, how="max"))


@query("m8_grad_edges", f"{G} SELECT src, dst, round(sum(a.v * b.v), 6) AS grad_w FROM w JOIN pf a ON a.id = src JOIN pf b ON b.id = dst AND b.pos = a.pos GROUP BY src, dst")
def m8(spark, d):
    e, x = _graph(spark, d)
    return message.spmm_grad_edges(e, x, x).select("src", "dst", F.round("grad_w", 6).alias("grad_w"))


@query("m8_grad_nodes", f"{G} SELECT src AS id, pos, round(sum(v * w), 6) AS val FROM w JOIN pf ON pf.id = dst GROUP BY src, pos")
def m8_nodes(spark, d):
    e, x = _graph(spark, d)
    return _out(message.spmm_grad_nodes(e, x, DIM, F.col("w")))


RAW = "r AS (SELECT src, dst, a.v + b.v AS raw FROM w JOIN pf a ON a.id = src AND a.pos = 0 JOIN pf b ON b.id = dst AND b.pos = 1), al AS (SELECT *, exp(CASE WHEN raw < 0 THEN 0.2 * raw ELSE raw END) / sum(exp(CASE WHEN raw < 0 THEN 0.2 * raw ELSE raw END)) OVER (PARTITION BY dst) AS alpha FROM r)"


def _gat(spark, d):
    e, x = _graph(spark, d)
    return message.gat_scores(e, x.select("id", F.col("x")[1].alias("value")), x.select("id", F.col("x")[0].alias("value"))), e, x


@query("m9_gat_scores", f"{G}, {RAW} SELECT src, dst, round(alpha, 6) AS alpha FROM al")
def m9(spark, d):
    return _gat(spark, d)[0].select("src", "dst", F.round("alpha", 6).alias("alpha"))


@query("m10_gat_grad", f"{G}, {RAW}, i AS (SELECT dst, sum(w.w * alpha) AS i FROM al JOIN w USING (src, dst) GROUP BY dst) SELECT al.src, al.dst, round(alpha * (w.w - i) * CASE WHEN raw < 0 THEN 0.2 ELSE 1.0 END, 6) AS grad_s FROM al JOIN w USING (src, dst) JOIN i ON i.dst = al.dst")
def m10(spark, d):
    scored, _, x = _gat(spark, d)
    raw = message.u_add_v(scored, x.select("id", F.col("x")[0].alias("value")), x.select("id", F.col("x")[1].alias("value")), "raw")
    return message.gat_grad(raw, "w").select("src", "dst", F.round("grad_s", 6).alias("grad_s"))


@query("m11_attention_sum", f"{G}, {RAW} SELECT dst AS id, pos, round(sum(v * alpha), 6) AS val FROM al JOIN pf ON pf.id = src GROUP BY dst, pos")
def m11(spark, d):
    scored, _, x = _gat(spark, d)
    return _out(message.spmm(scored, x, DIM, F.col("alpha")))


def _norm(kind: str) -> str:
    w = {"both": "1 / sqrt(o * i)", "root": "sqrt(o * i)", "right": "1.0::DOUBLE / i"}[kind]
    return f"{G}, o AS (SELECT src, count(*) AS o FROM w GROUP BY src), i AS (SELECT dst, count(*) AS i FROM w GROUP BY dst), n AS (SELECT w.src, w.dst, {w} AS w FROM w JOIN o ON o.src = w.src JOIN i ON i.dst = w.dst) {_sum('sum(v * w)', 'n')}"


for _kind in ("both", "root", "right"):

    @query(f"m14_gcn_{_kind}", _norm(_kind))
    def m14(spark, d, kind=_kind):
        e, x = _graph(spark, d)
        return _out(message.spmm(message.gcn_weights(e.drop("w"), x, kind), x, DIM, F.col("w")))


W = layers.weights(4, DIM)
V = layers.weights(4, DIM, 5)


def _literal(m) -> str:
    return "(VALUES " + ", ".join(f"({i}, {j}, {v}::DOUBLE)" for i, r in enumerate(m) for j, v in enumerate(r)) + ")"


def _dense(of: str, m, key: str = "id") -> str:
    return f"(SELECT {key}, k.o AS pos, sum(k.m * t.v) AS v FROM {of} t JOIN {_literal(m)} k(o, i, m) ON k.i = t.pos GROUP BY {key}, k.o)"


FULL = "SELECT p.id, p.pos, coalesce(a.v, 0.0) AS v FROM pf p LEFT JOIN a ON a.id = p.id AND a.pos = p.pos"


@query("t5_linear", f"{G} SELECT id, pos, round(v, 6) AS val FROM {_dense('pf', W)}")
def t5(spark, d):
    return _out(layers.dense(_graph(spark, d)[1], W))


@query("l3_gin", f"{G}, a AS (SELECT dst AS id, pos, 0.5 * sum(v) AS v FROM w JOIN pf ON pf.id = src GROUP BY dst, pos), z AS ({FULL}) SELECT id, pos, round(v, 6) AS val FROM {_dense('z', W)}")
def l3(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.gin(e, x, W))


@query("l8_gin_mlp", f"{G}, a AS (SELECT dst AS id, pos, avg(v) AS v FROM w JOIN pf ON pf.id = src GROUP BY dst, pos), z AS (SELECT p.id, p.pos, p.v + coalesce(a.v, 0.0) AS v FROM pf p LEFT JOIN a ON a.id = p.id AND a.pos = p.pos) SELECT id, pos, round(greatest(v, 0.0), 6) AS val FROM {_dense('z', W)}")
def l8(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.gin_mlp(e, x, W))


@query("l1_gcn", f"{_norm('both').rsplit('SELECT dst AS id', 1)[0]}, a AS (SELECT dst AS id, pos, sum(v * w) AS v FROM n JOIN pf ON pf.id = src GROUP BY dst, pos), z AS ({FULL}) SELECT id, pos, round(v, 6) AS val FROM {_dense('z', W)}")
def l1(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.gcn(e.drop("w"), x, W))


def _sage(agg: str, pre: str = "v") -> str:
    return f"{G}, a AS (SELECT dst AS id, pos, {agg}({pre}) AS v FROM w JOIN pf ON pf.id = src GROUP BY dst, pos), z AS ({FULL}) SELECT s.id, s.pos, round(s.v + n.v, 6) AS val FROM {_dense('pf', W)} s JOIN {_dense('z', V)} n ON n.id = s.id AND n.pos = s.pos"


@query("l4_sage_mean", _sage("avg"))
def l4(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.sage(e, x, W, V))


@query("l4_sage_pool", _sage("max", "greatest(v, 0.0)"))
def l4_pool(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.sage(e, x, W, V, "pool"))


@query("l4_sage_gcn", f"{G}, lp AS (SELECT src, dst FROM w UNION ALL SELECT p_partkey, p_partkey FROM part), z AS (SELECT dst AS id, pos, avg(v) AS v FROM lp JOIN pf ON pf.id = src GROUP BY dst, pos) SELECT id, pos, round(v, 6) AS val FROM {_dense('z', V)}")
def l4_gcn(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.sage(e, x, W, V, "gcn"))


@query("l4_sage_fold", f"{G}, o AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src DESC) - 1 AS k FROM w), a AS (SELECT dst AS id, pos, sum(v * pow(0.5, k)) AS v FROM o JOIN pf ON pf.id = src GROUP BY dst, pos), z AS ({FULL}) SELECT s.id, s.pos, round(s.v + n.v, 6) AS val FROM {_dense('pf', W)} s JOIN {_dense('z', V)} n ON n.id = s.id AND n.pos = s.pos")
def l4_fold(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.sage(e, x, W, V, "fold"))


@query("t6_embed", f"{G}, s AS (SELECT id, round(sum(v), 5) AS total FROM pf GROUP BY id) SELECT l_orderkey AS ord, l_linenumber AS line, total FROM lineitem JOIN s ON s.id = l_partkey")
def t6(spark, d):
    """A parameter table's vectors for the parts of order lines."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("id"))
    return layers.embed(rows, _graph(spark, d)[1]).select("ord", "line", F.round(vec.total(F.col("x")), 5).alias("total"))


@query("l2_left_weighted", f"{G}, o AS (SELECT src, count(*) AS o FROM w GROUP BY src), a AS (SELECT w.dst AS id, pos, sum(v * w.w / o) AS v FROM w JOIN o ON o.src = w.src JOIN pf ON pf.id = w.src GROUP BY w.dst, pos), z AS ({FULL}) SELECT id, pos, round(greatest(v + 0.1 * (pos - 1), 0), 6) AS val FROM {_dense('z', W)}")
def l2(spark, d):
    """A layer with the sources' norm, edge weights, bias and activation."""
    e, x = _graph(spark, d)
    return _out(layers.gcn(e, x, W, "left", [0.1 * (i - 1) for i in range(4)], vec.relu, "w"))


@query("l4_sage_lstm")
def l4_lstm(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.sage(e, x, W, layers.weights(4, 3, 7), "lstm", lstm=LSTM, fan=4))


#: A small recurrent cell over vectors, for examples and tests.
LSTM = layers.Lstm(layers.weights(12, DIM, 2), layers.weights(12, 3, 5), [0.1 * (i % 3) for i in range(12)])


@query("m14_gcn_weight_grad", f"{_norm('both').rsplit('SELECT dst AS id', 1)[0]}, a AS (SELECT dst AS id, pos, sum(v * w) AS v FROM n JOIN pf ON pf.id = src GROUP BY dst, pos) SELECT g.pos AS row, a.pos AS col, round(sum(g.v * a.v), 5) AS grad FROM a JOIN pf g ON g.id = a.id AND g.pos < 4 GROUP BY g.pos, a.pos")
def m14_grad(spark, d):
    """The derivative by a layer's weights, given that by its output (here the first four numbers of each vector)."""
    e, x = _graph(spark, d)
    grad = x.select("id", F.slice("x", 1, 4).alias("x"))
    out = message.weight_grad(message.spmm(message.gcn_weights(e.drop("w"), x), x, DIM, F.col("w")), grad, 4, DIM)
    return out.withColumn("grad", F.round("grad", 5))


@query("m15_gin_weight_grad", f"{G}, a AS (SELECT dst AS id, pos, 0.5 * sum(v) AS v FROM w JOIN pf ON pf.id = src GROUP BY dst, pos) SELECT g.pos AS row, a.pos AS col, round(sum(g.v * a.v), 5) AS grad FROM a JOIN pf g ON g.id = a.id AND g.pos < 4 GROUP BY g.pos, a.pos")
def m15_grad(spark, d):
    e, x = _graph(spark, d)
    out = layers.gin_grads(e, x, x.select("id", F.slice("x", 1, 4).alias("x")), W)[0]
    return out.withColumn("grad", F.round("grad", 5))


@query("m15_gin_input_grad", f"{G}, b AS (SELECT src AS id, pos, 0.5 * sum(v) AS v FROM w JOIN pf ON pf.id = dst WHERE pos < 4 GROUP BY src, pos), m AS ({' UNION ALL '.join(f'SELECT {i} AS r, {j} AS c, {v}::DOUBLE AS k' for i, row in enumerate(W) for j, v in enumerate(row))}) SELECT id, c AS pos, round(sum(v * k), 5) AS val FROM b JOIN m ON m.r = b.pos GROUP BY id, c")
def m15_input_grad(spark, d):
    e, x = _graph(spark, d)
    return vec.long_form(layers.gin_grads(e, x, x.select("id", F.slice("x", 1, 4).alias("x")), W)[1], ["id"], "x", 5)


def _heads(n: int, salt: int = 0) -> list:
    return [(layers.weights(4, DIM, h + salt), [0.5, -0.25, 0.5, -0.25], [0.1, 0.2, 0.3, 0.4]) for h in range(n)]


def _gat_sql(of: str, heads: list, out: str) -> str:
    """CTEs that give `out` (id, pos, v): the mean over heads of attention along the edges `of`."""
    rows = ", ".join(f"({h}, {i}, {j}, {v}::DOUBLE)" for h, (w, _, _) in enumerate(heads) for i, r in enumerate(w) for j, v in enumerate(r))
    leaky = "CASE WHEN a.k + b.q < 0 THEN 0.2 * (a.k + b.q) ELSE a.k + b.q END"
    return f"""{out}_h AS MATERIALIZED (SELECT id, k.h, k.o AS pos, sum(k.m * t.v) AS v FROM pf t JOIN (VALUES {rows}) k(h, o, i, m) ON k.i = t.pos GROUP BY id, k.h, k.o),
{out}_q AS MATERIALIZED (SELECT id, h, sum(v * (CASE WHEN pos % 2 = 0 THEN 0.5 ELSE -0.25 END)) AS q, sum(v * (0.1 * (pos + 1))) AS k FROM {out}_h GROUP BY id, h),
{out}_s AS (SELECT e.src, e.dst, a.h, {leaky} AS s FROM {of} e JOIN {out}_q a ON a.id = e.src JOIN {out}_q b ON b.id = e.dst AND b.h = a.h),
{out}_t AS (SELECT *, exp(s - max(s) OVER (PARTITION BY dst, h)) AS x FROM {out}_s),
{out}_a AS MATERIALIZED (SELECT src, dst, h, x / sum(x) OVER (PARTITION BY dst, h) AS alpha FROM {out}_t),
{out} AS (SELECT dst AS id, pos, sum(v * alpha) / {len(heads)} AS v FROM {out}_a al JOIN {out}_h h ON h.id = src AND h.h = al.h GROUP BY dst, pos)"""


@query("l9_gat", f"{G}, {_gat_sql('w', _heads(8), 'g')} SELECT id, pos, round(v, 6) AS val FROM g")
def l9(spark, d):
    e, x = _graph(spark, d)
    return _out(layers.gat(e, x, _heads(8)))


def _relations(spark, d):
    from weftgraph.operators.structure import stitch

    return stitch({"follows": part_graph(spark, d), "supplies": supply_graph(spark, d)})


@query("l10_rgat", f"{G}, {SUPPLY_GRAPH}, sp AS (SELECT s.* FROM s JOIN part ON p_partkey = src), {_gat_sql('w', _heads(2), 'g')}, {_gat_sql('sp', _heads(2, 3), 'k')} SELECT id, pos, round(avg(v), 6) AS val FROM (SELECT * FROM g UNION ALL SELECT * FROM k) GROUP BY id, pos")
def l10_rgat(spark, d):
    return _out(layers.rgat(_relations(spark, d), _graph(spark, d)[1], [_heads(2), _heads(2, 3)]))


@query("l10_rgcn", f"{G}, {SUPPLY_GRAPH}, a0 AS (SELECT dst AS id, pos, avg(v) AS v FROM w JOIN pf ON pf.id = src GROUP BY dst, pos), a1 AS (SELECT dst AS id, pos, avg(v) AS v FROM s JOIN pf ON pf.id = src GROUP BY dst, pos), z AS (SELECT * FROM {_dense('a0', W)} UNION ALL SELECT * FROM {_dense('a1', V)}) SELECT id, pos, round(avg(v), 6) AS val FROM z GROUP BY id, pos")
def l10_rgcn(spark, d):
    return _out(layers.rgcn(_relations(spark, d), _graph(spark, d)[1], [W, V]))


@query("l7_control_variate", f"""{G}, sm AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY (dst * 2654435761 + src * 40503 + 3) % 2147483629, src) AS n FROM w) WHERE n <= 2),
c AS (SELECT dst AS id, pos, avg(0.25 * v) AS v FROM sm JOIN pf ON pf.id = src GROUP BY dst, pos), a AS (SELECT dst AS id, pos, avg(0.75 * v) AS v FROM w JOIN pf ON pf.id = src GROUP BY dst, pos)
SELECT p.id, p.pos, round(coalesce(a.v, 0.0) + coalesce(c.v, 0.0), 6) AS val FROM pf p LEFT JOIN a ON a.id = p.id AND a.pos = p.pos LEFT JOIN c ON c.id = p.id AND c.pos = p.pos""")
def l7(spark, d):
    from weftgraph.operators.sampling import neighbours

    e, x = _graph(spark, d)
    sampled = neighbours(e, x.select("id"), 2, 3, into=True).select(F.col("nbr").alias("src"), F.col("seed").alias("dst"))
    old = x.withColumn("x", vec.scale(F.col("x"), F.lit(0.75)))
    return _out(layers.control_variate(sampled, e, x, old, DIM))


@query("l10_hetero", f"{G}, {SUPPLY_GRAPH}, r AS (SELECT src, dst, 0 AS bid FROM w UNION ALL SELECT src, dst, 1 FROM s), a AS (SELECT bid, dst AS id, pos, avg(v) AS v FROM r JOIN pf ON pf.id = src GROUP BY bid, dst, pos) SELECT id, pos, round(avg(v), 6) AS val FROM a GROUP BY id, pos")
def l10(spark, d):
    from weftgraph.operators.structure import stitch

    shared, index = part_vectors(spark, d)
    return _out(layers.hetero_conv(stitch({"follows": part_steps(spark, d), "supplies": supplies(spark, d)}), index, DIM, shared, once=True))


@query("l13_edge_predictor", f"{G}, a AS (SELECT * FROM {_dense('pf', W)}), b AS (SELECT * FROM {_dense('pf', V)}) SELECT src, dst, round(sum(greatest(a.v + b.v, 0.0) * (a.pos + 1)), 6) AS score FROM w JOIN a ON a.id = src JOIN b ON b.id = dst AND b.pos = a.pos GROUP BY src, dst")
def l13(spark, d):
    e, x = _graph(spark, d)
    return layers.edge_predictor(e, x, W, V, [1, 2, 3, 4]).select("src", "dst", F.round("score", 6).alias("score"))


@query("l14_classifier", f"{G}, h AS (SELECT id, pos, greatest(v, 0.0) AS v FROM {_dense('pf', W)}), o AS (SELECT * FROM {_dense('h', layers.weights(3, 4, 2))}), p AS (SELECT id, pos, exp(v) / sum(exp(v)) OVER (PARTITION BY id) AS p FROM o) SELECT id, pos, round(p, 6) AS val FROM p")
def l14(spark, d):
    out = layers.node_classifier(_graph(spark, d)[1], W, layers.weights(3, 4, 2))
    return vec.long_form(out, ["id"], "p")


@query("t11_activations", f"{G} SELECT id, pos, round(greatest(v, 0.0), 6) AS relu, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 6) AS elu, round(CASE WHEN v < 0 THEN 0.2 * v ELSE v END, 6) AS leaky, round(1 / (1 + exp(-v)), 6) AS sigmoid FROM pf")
def t11(spark, d):
    x = _graph(spark, d)[1]
    rows = x.select("id", F.posexplode(F.arrays_zip(F.col("x").alias("v"), vec.relu(F.col("x")).alias("r"), vec.elu(F.col("x")).alias("e"))).alias("pos", "a"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.round("a.r", 6).alias("relu"), F.round("a.e", 6).alias("elu"), F.round(vec.leaky_relu(F.col("a.v")), 6).alias("leaky"), F.round(vec.sigmoid(F.col("a.v")), 6).alias("sigmoid"))


@query("t18_layer_norm", f"{G}, m AS (SELECT id, avg(v) AS m, var_pop(v) AS s FROM pf GROUP BY id) SELECT pf.id, pos, round((v - m) / sqrt(s + 1e-5), 6) AS val FROM pf JOIN m ON m.id = pf.id")
def t18(spark, d):
    return _out(_graph(spark, d)[1].withColumn("x", vec.layer_norm(F.col("x"))))


@query("t20_l2_normalise", f"{G}, m AS (SELECT id, sqrt(sum(v * v)) AS n FROM pf GROUP BY id) SELECT pf.id, pos, round(v / n, 6) AS val FROM pf JOIN m ON m.id = pf.id")
def t20(spark, d):
    return _out(_graph(spark, d)[1].withColumn("x", vec.l2_normalise(F.col("x"))))


@query("p17_row_normalise", f"{G}, m AS (SELECT id, sum(v) AS n FROM pf GROUP BY id) SELECT pf.id, pos, round(v / n, 6) AS val FROM pf JOIN m ON m.id = pf.id")
def p17(spark, d):
    return _out(_graph(spark, d)[1].withColumn("x", vec.row_normalise(F.col("x"))))


@query("t19_softmax", f"{G} SELECT id, pos, round(exp(v) / sum(exp(v)) OVER (PARTITION BY id), 6) AS val FROM pf")
def t19(spark, d):
    return _out(_graph(spark, d)[1].withColumn("x", vec.softmax(F.col("x"))))


@query("p28_argmax", f"{G} SELECT id, CAST(arg_max(pos, (v, -pos)) AS INTEGER) AS best FROM pf GROUP BY id")
def p28(spark, d):
    return _graph(spark, d)[1].select("id", vec.argmax(F.col("x")).alias("best"))


@query("t2_t4_t9_arrays", f"{G} SELECT id, pos, round(3 * v + v * v, 6) AS val FROM pf UNION ALL SELECT id, 64 + pos, round(v, 6) FROM pf")
def t2(spark, d):
    x = F.col("x")
    return _out(_graph(spark, d)[1].select("id", F.concat(vec.add(vec.scale(x, F.lit(3.0)), vec.mul(x, x)), x).alias("x")))


@query("t7_t8_mean_heads", f"{G} SELECT id, pos % 32 AS pos, round(avg(v), 6) AS val FROM pf GROUP BY id, pos % 32")
def t7(spark, d):
    return _out(_graph(spark, d)[1].select("id", vec.mean_rows(vec.reshape(F.col("x"), 2, 32), 2).alias("x")))


@query("t16_time_encoding", "SELECT event_id AS id, k.pos, round(cos((event_id % 1000) * pow(10, -3.0 * k.pos)), 6) AS val FROM events, (SELECT unnest(range(4)) AS pos) k")
def t16(spark, d):
    return _out(table(spark, d, "events").select(F.col("event_id").alias("id"), vec.time_encoding(F.col("event_id") % 1000, 4).alias("x")))


@query("r5_feature_slices", f"{G} SELECT id, CAST(least(pos // 21, 2) AS BIGINT) AS part, pos - 21 * CAST(least(pos // 21, 2) AS BIGINT) AS pos, round(v, 6) AS val FROM pf")
def r5(spark, d):
    from weftgraph.operators.partition import feature_slices

    return _out(feature_slices(_graph(spark, d)[1], 3, DIM), ("id", "part"))


@query("p16_gather", f"{G}, s AS MATERIALIZED (SELECT id, string_agg(CAST(round(v * 1000000) AS BIGINT), ',' ORDER BY pos) AS vector FROM pf GROUP BY id) SELECT req, id, vector FROM (SELECT DISTINCT l_orderkey AS req, l_partkey AS id FROM lineitem) q JOIN s USING (id)")
def p16(spark, d):
    """The whole vectors that requests ask for, in millionths."""
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("req"), F.col("l_partkey").alias("id")).distinct()
    vector = F.array_join(F.transform("x", lambda v: F.round(v * 1_000_000).cast("long").cast("string")), ",")
    return _graph(spark, d)[1].select("id", vector.alias("vector")).join(q, "id").select("req", "id", "vector")


@query("m19_mean_features", f"{G} {_sum('avg(v)', 'e')}")
def m19(spark, d):
    return _out(message.spmm(part_graph(spark, d), part_features(spark, d), DIM, how="mean"))


@query("g11_modularity", f"WITH {PART_GRAPH}, b AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2), c AS (SELECT src % 7 AS c, sum(w) AS whole, sum(CASE WHEN src % 7 = dst % 7 THEN w ELSE 0 END) AS inside FROM b GROUP BY 1) SELECT round(sum(inside / m2 - pow(whole / m2, 2)), 6) AS q FROM c, (SELECT sum(whole) AS m2 FROM c)")
def g11(spark, d):
    from weftgraph.operators.structure import merge_parallel, with_reverse

    labels = part_vertices(spark, d).withColumn("community", F.col("id") % 7)
    return community.modularity(merge_parallel(with_reverse(part_graph(spark, d))), labels).select(F.round("q", 6).alias("q"))


@query("g10_communities")
def g10(spark, d):
    return community.merge_communities(part_graph(spark, d), part_vertices(spark, d))


@query("g12_reorder")
def g12(spark, d):
    """Edges between the places of their ends in a walk through the merges of communities."""
    e, v = stored(part_graph(spark, d)), part_vertices(spark, d)
    return community.reorder(e, community.order_by_forest(v, community.merge_forest(e, v)[1])).select("src", "dst", "w")


@query("g13_degree_order", f"WITH {PART_GRAPH} SELECT id, row_number() OVER (ORDER BY n DESC, id) - 1 AS new FROM (SELECT p_partkey AS id, count(e.src) AS n FROM part LEFT JOIN e ON e.dst = p_partkey GROUP BY 1)")
def g13(spark, d):
    return community.order_by_degree(part_graph(spark, d), part_vertices(spark, d))


SCORED = "s AS (SELECT (l_orderkey * 7919 + l_linenumber * 104729) % 10007 / 10007.0::DOUBLE AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_orderkey AS query FROM lineitem)"


def _scored(spark, d):
    k = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 10007 / F.lit(10007.0)
    return table(spark, d, "lineitem").select(k.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_orderkey").alias("query"))


@query("l16_binary_metrics", f"""WITH {SCORED}, g AS (SELECT score AS s, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY 1),
r AS (SELECT *, sum(p) OVER o AS tp, sum(q) OVER o AS fp FROM g WINDOW o AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(sum(p + q) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives, round(sum(CASE WHEN s >= 0.5 THEN p ELSE q END) / sum(p + q), 6) AS accuracy, round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM r""")
def l16(spark, d):
    m = metrics.binary_metrics(_scored(spark, d))
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "auc", "average_precision")})


@query("l16_mrr", f"""WITH {SCORED}, b AS (SELECT query, max(score) AS p FROM s WHERE label = 1 GROUP BY query)
SELECT round(avg(r), 6) AS mrr FROM (SELECT s.query, 1.0::DOUBLE / (1 + sum(CASE WHEN s.score > b.p THEN 1 ELSE 0 END)) AS r FROM s JOIN b ON b.query = s.query WHERE label = 0 GROUP BY s.query)""")
def l16_mrr(spark, d):
    s = _scored(spark, d)
    best = s.where("label = 1").groupBy("query").agg(F.max("score").alias("score")).withColumn("label", F.lit(1))
    return metrics.mean_reciprocal_rank(s.where("label = 0").unionByName(best, allowMissingColumns=True)).select(F.round("mrr", 6).alias("mrr"))


@query("l15_cross_entropy", f"WITH {SCORED} SELECT round(avg(-ln(greatest(CASE WHEN label = 1 THEN score ELSE 1 - score END, 1e-12))), 6) AS loss FROM s")
def l15(spark, d):
    p = F.array(1 - F.col("score"), F.col("score"))
    return _scored(spark, d).agg(F.round(F.avg(layers.cross_entropy(p, F.col("label"))), 6).alias("loss"))


@query("l15_nll_bce", f"WITH {SCORED} SELECT round(avg(-ln(CASE WHEN label = 1 THEN 1 / (1 + exp(-score)) ELSE 1 - 1 / (1 + exp(-score)) END)), 6) AS nll, round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 6) AS bce FROM s")
def l15_more(spark, d):
    log_p = vec.log_softmax(F.array(F.lit(0.0), F.col("score")))
    rows = _scored(spark, d)
    return rows.agg(F.round(F.avg(layers.nll(log_p, F.col("label"))), 6).alias("nll"), F.round(F.avg(layers.bce_with_logits(F.col("score"), F.col("label"))), 6).alias("bce"))


@query("l16_micro_f1", "WITH s AS (SELECT l_linenumber % 3 AS p, l_suppkey % 3 AS y FROM lineitem) SELECT round(2.0::DOUBLE * sum(CASE WHEN p = y THEN 1 ELSE 0 END) / (2 * sum(CASE WHEN p = y THEN 1 ELSE 0 END) + 2 * sum(CASE WHEN p <> y THEN 1 ELSE 0 END)), 6) AS f1 FROM s")
def l16_f1(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("predicted"), (F.col("l_suppkey") % 3).alias("label"))
    return metrics.micro_f1(rows).select(F.round("f1", 6).alias("f1"))


@query("t10_t13_squeeze", f"{G} SELECT id, pos, round(v, 6) AS val FROM pf")
def t10(spark, d):
    """An outer dimension of one goes, and dropping out does nothing outside of training."""
    x = _graph(spark, d)[1]
    return _out(x.select("id", vec.drop_out(vec.squeeze(vec.reshape(F.col("x"), 1, DIM)), 0.5, False, F.col("id")).alias("x")))


@query("t17_time_projection", f"{G} SELECT id, pos, round(v * (1 + (0.1 * (pos % 5) - 0.2) * ((id + 10) - id % 7) / (id + 11)::DOUBLE), 6) AS val FROM pf")
def t17(spark, d):
    w = [0.1 * (i % 5) - 0.2 for i in range(DIM)]
    x = _graph(spark, d)[1]
    return _out(x.select("id", vec.time_projection(F.col("x"), F.col("id") + 10, F.col("id") % 7, w).alias("x")))


@query("l18_inference", f"{_norm('both').rsplit('SELECT dst AS id', 1)[0]}, a AS (SELECT dst AS id, pos, sum(v * w) AS v FROM n JOIN pf ON pf.id = src GROUP BY dst, pos), z AS ({FULL}), g AS (SELECT * FROM {_dense('z', W)}), h AS (SELECT id, pos, greatest(v, 0.0) AS v FROM {_dense('g', layers.weights(4, 4, 1))}), c AS (SELECT * FROM {_dense('h', layers.weights(3, 4, 2))}) SELECT id, CAST(arg_max(pos, (v, -pos)) AS INTEGER) AS label FROM c WHERE id IN (SELECT p_partkey FROM part WHERE p_size <= 2) GROUP BY id")
def l18(spark, d):
    """Labels of the seed parts from their embeddings of a graph layer."""
    from weftgraph.sources.graphs import seeds

    e, x = _graph(spark, d)
    embedded = layers.gcn(e.drop("w"), x, W).join(seeds(spark, d), "id", "left_semi")
    return layers.node_classifier(embedded, layers.weights(4, 4, 1), layers.weights(3, 4, 2)).select("id", "label")
