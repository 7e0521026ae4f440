"""Inference layers of graph networks over (edges, features)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import vectors as vec
from weftgraph.operators import message, sampling

Matrix = Sequence[Sequence[float]]


def weights(rows: int, cols: int, salt: int = 0) -> list[list[float]]:
    """A fixed small matrix by rule, for examples and tests."""
    return [[((i * 7 + j * 3 + salt) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]


def dense(x: DataFrame, w: Matrix, bias: Sequence[float] | None = None) -> DataFrame:
    return x.withColumn("x", vec.linear(F.col("x"), w, bias))


def filled(found: DataFrame, x: DataFrame, dim: int) -> DataFrame:
    """Vectors of all nodes of x: zeros where nothing arrived."""
    zero = F.array(*[F.lit(0.0)] * dim)
    return x.select("id").join(found, "id", "left").select("id", F.coalesce("x", zero).alias("x"))


def gcn(edges: DataFrame, x: DataFrame, w: Matrix, norm: str = "both", bias: Sequence[float] | None = None, activation: Callable[[Column], Column] | None = None, weight: str | None = None) -> DataFrame:
    """Normalised sum of the neighbours' features times w, plus bias, through an activation; the cheaper
    of both orders is planned: multiply first if that makes vectors shorter. With `weight`, a column of
    edges, each neighbour counts by it besides the norm."""
    e = message.gcn_weights(edges.withColumnRenamed(weight, "_weight") if weight else edges, x, norm)
    e = e.withColumn("w", F.col("w") * F.col("_weight")) if weight else e
    out, inp = len(w), len(w[0])
    if out < inp:
        y = filled(message.spmm(e, dense(x, w), out, F.col("w")), x, out)
    else:
        y = dense(filled(message.spmm(e, x, inp, F.col("w")), x, inp), w)
    if bias is not None:
        y = y.withColumn("x", vec.add(F.col("x"), F.array(*[F.lit(float(b)) for b in bias])))
    return y if activation is None else y.withColumn("x", activation(F.col("x")))


def embed(rows: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """rows with x, the vector that a table (id, x) has for their `key`; rows without one go."""
    return rows.join(table.select(F.col("id").alias(key), "x"), key)


def gin(edges: DataFrame, x: DataFrame, w: Matrix, eps: float = 0.5) -> DataFrame:
    """eps times the sum of the neighbours, times w."""
    dim = len(w[0])
    s = filled(message.spmm(edges, x, dim), x, dim)
    return dense(s.withColumn("x", vec.scale(F.col("x"), F.lit(eps))), w)


def gin_grads(edges: DataFrame, x: DataFrame, grad: DataFrame, w: Matrix, eps: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The derivatives of gin() by w, (row, col, grad), and by x, (id, x), given that by its output,
    grad (id, x). Nodes without edges have no row in the second, which stands for zeros."""
    dim = len(w[0])
    sums = message.spmm(edges, x, dim).withColumn("x", vec.scale(F.col("x"), F.lit(eps)))
    by_w = message.weight_grad(sums, grad, len(w), dim)
    back = message.spmm_grad_nodes(edges, grad, len(w)).withColumn("x", vec.scale(F.col("x"), F.lit(eps)))
    return by_w, dense(back, [list(col) for col in zip(*w, strict=True)])


@dataclass
class Lstm:
    """Weights of a recurrent cell with input, forget, candidate and output gates in this order:
    (4 * dim, inputs), (4 * dim, dim) and 4 * dim biases."""

    w: Matrix
    u: Matrix
    b: Sequence[float]

    @property
    def dim(self) -> int:
        return len(self.u[0])

    def step(self, state: Column, gates: Column) -> Column:
        """The state (h, c) after an input whose part of the gates, w x + b, is given."""
        d = self.dim
        z = vec.add(gates, vec.linear(state["h"], self.u))
        part = lambda p, i: F.slice(p["z"], i * d + 1, d)
        sigmoid = lambda v: F.transform(v, vec.sigmoid)

        def cell(p: Column) -> Column:
            c = vec.add(vec.mul(sigmoid(part(p, 1)), p["c"]), vec.mul(sigmoid(part(p, 0)), F.transform(part(p, 2), F.tanh)))
            return F.struct(c.alias("c"), sigmoid(part(p, 3)).alias("o"))

        def shown(p: Column) -> Column:
            return F.struct(vec.mul(p["o"], F.transform(p["c"], F.tanh)).alias("h"), p["c"].alias("c"))

        once = F.transform(F.array(F.struct(z.alias("z"), state["c"].alias("c"))), cell)
        return F.transform(once, shown)[0]


def lstm_reduce(edges: DataFrame, x: DataFrame, cell: Lstm, fan: int, salt: int = 0) -> DataFrame:
    """(id, x): the last state of a recurrent cell over the vectors of at most `fan` in-neighbours of
    each target, drawn by hash, in the order of their ids.

    The inputs' part of the gates is multiplied once for each vector and not for each edge. A target
    gets a list of at most `fan` of them and goes along it in one expression, so there's one shuffle
    by target, whatever the fan is, and no hub with a longer list than others.
    """
    near = sampling.neighbours(edges, edges.select(F.col("dst").alias("id")).distinct(), fan, salt, into=True)
    gates = x.select(F.col("id").alias("nbr"), vec.linear(F.col("x"), cell.w, cell.b).alias("g"))
    lists = near.join(gates, "nbr").groupBy(F.col("seed").alias("id")).agg(F.array_sort(F.collect_list(F.struct("nbr", "g"))).alias("l"))
    zero = F.array(*[F.lit(0.0)] * cell.dim)
    last = F.aggregate("l", F.struct(zero.alias("h"), zero.alias("c")), lambda s, p: cell.step(s, p["g"]), lambda s: s["h"])
    return lists.select("id", last.alias("x"))


def gin_mlp(edges: DataFrame, x: DataFrame, w: Matrix, eps: float = 0.0) -> DataFrame:
    """relu(w ((1 + eps) x + mean of the neighbours))."""
    dim = len(w[0])
    m = filled(message.spmm(edges, x, dim, how="mean"), x, dim).withColumnRenamed("x", "m")
    both = x.join(m, "id").select("id", vec.add(vec.scale(F.col("x"), F.lit(1.0 + eps)), F.col("m")).alias("x"))
    return dense(both, w).withColumn("x", vec.relu(F.col("x")))


def sage(edges: DataFrame, x: DataFrame, w_self: Matrix, w_near: Matrix, how: str = "mean", normalise: bool = False, lstm: Lstm | None = None, fan: int = 10, pool: tuple[Matrix, Sequence[float]] | None = None) -> DataFrame:
    """w_self x + w_near r(neighbours); r is mean, max after relu ("pool", with `pool` the weights and
    biases of a layer before it), the mean that includes the node itself ("gcn"), the last state of a
    recurrent cell over at most `fan` neighbours ("lstm"), or a recurrent fold ("fold"). Neighbours'
    part is zero where there are none."""
    dim = len(w_near[0])
    if how == "gcn":
        loops = x.select(F.col("id").alias("src"), F.col("id").alias("dst"))
        near = message.spmm(edges.select("src", "dst").union(loops), x, dim, how="mean")
        out = dense(near, w_near)
    else:
        first = how in ("mean", "fold") and len(w_near) < dim  # both are linear: multiply if that makes vectors shorter
        y = dense(x, w_near) if first else x
        dim = len(w_near) if first else dim
        if how == "fold":
            near = message.spmm(message.fold_weights(edges), y, dim, F.col("w"))
        elif how == "lstm":
            near = lstm_reduce(edges, x, lstm, fan)
        elif how == "pool":
            near = message.spmm(edges, (dense(x, *pool) if pool else x).withColumn("x", vec.relu(F.col("x"))), dim, how="max")
        else:
            near = message.spmm(edges, y, dim, how="mean")
        near = filled(near, x, dim).withColumnRenamed("x", "n")
        out = x.join(near, "id").select("id", vec.add(vec.linear(F.col("x"), w_self), F.col("n") if first else vec.linear(F.col("n"), w_near)).alias("x"))
    return out.withColumn("x", vec.l2_normalise(F.col("x"))) if normalise else out


def gat(edges: DataFrame, x: DataFrame, heads: Sequence[tuple[Matrix, Sequence[float], Sequence[float]]]) -> DataFrame:
    """Attention, the mean over heads of sum(alpha * w x[src]); a head is (w, query, key)."""
    dim, n = len(heads[0][0]), len(heads)
    own = lambda v, h: F.slice(v, h * dim + 1, dim)
    scores = lambda side: F.array(*[vec.dot(own(F.col("_all"), h), F.array(*[F.lit(float(v)) for v in head[side]])) for h, head in enumerate(heads)])
    # all heads' vectors are multiplied at once, and edges are joined with them once
    nodes = x.select("id", vec.linear(F.col("x"), [row for head in heads for row in head[0]]).alias("_all")).select("id", "_all", scores(1).alias("_q"), scores(2).alias("_k"))
    src = nodes.select(F.col("id").alias("src"), "_all", "_k")
    met = edges.select("src", "dst").join(src, "src").join(nodes.select(F.col("id").alias("dst"), "_q"), "dst")
    rows = met.select(F.col("dst").alias("id"), "_all", F.transform(vec.add(F.col("_q"), F.col("_k")), lambda s: vec.leaky_relu(s)).alias("_s"))
    sums = message.softmax_sums(rows, ("id",), "_s", "_all", n, dim)
    return sums.select("id", F.array(*[sum((F.col("x")[h * dim + i] for h in range(1, n)), F.col("x")[i]) / n for i in range(dim)]).alias("x"))


def attention(rows: DataFrame, heads: int, dim: int) -> DataFrame:
    """(dst, x): of rows (dst, q, k, v) the sum of v, weighted by the softmax over a dst's rows of
    leaky_relu(dot(q, k)); vectors of `dim` numbers are cut into `heads` that attend on their own."""
    d = dim // heads
    part = lambda c, h: F.slice(c, h * d + 1, d)
    scores = F.array(*[vec.leaky_relu(vec.dot(part("q", h), part("k", h))) for h in range(heads)])
    return message.softmax_sums(rows.select("dst", "v", scores.alias("_s")), ("dst",), "_s", "v", heads, d)


def control_variate(sampled: DataFrame, edges: DataFrame, x: DataFrame, history: DataFrame, dim: int) -> DataFrame:
    """(id, x): the mean over sampled neighbours of what changed since history (id, x), plus the mean
    of history over all neighbours; nodes without neighbours have zeros."""
    h = history.select("id", F.col("x").alias("_h"))
    change = x.join(h, "id").select("id", vec.sub(F.col("x"), F.col("_h")).alias("x"))
    part = filled(message.spmm(sampled, change, dim, how="mean"), x, dim).withColumnRenamed("x", "_c")
    whole = filled(message.spmm(edges, history, dim, how="mean"), x, dim)
    return whole.join(part, "id").select("id", vec.add(F.col("x"), F.col("_c")).alias("x"))


def rgcn(relations: DataFrame, x: DataFrame, ws: Sequence[Matrix]) -> DataFrame:
    """(id, x): as hetero_conv(), with the weights ws[bid] of each relation."""
    dim, out = len(ws[0][0]), len(ws[0])
    if out * len(ws) < dim:  # multiplied first, all relations' products are shorter than one vector
        y = dense(x, [row for w in ws for row in w])
        m = message.copy_u(relations.where(F.col("bid").between(0, len(ws) - 1)), y)
        m = m.select("bid", F.col("dst").alias("id"), F.slice("x", F.col("bid").cast("int") * out + 1, out).alias("x"))
        return vec.reduce_vectors(vec.reduce_vectors(m, ["bid", "id"], "x", out, "mean"), ["id"], "x", out, "mean")
    m = message.copy_u(relations, x).select("bid", F.col("dst").alias("id"), "x")
    each = vec.reduce_vectors(m, ["bid", "id"], "x", dim, "mean")
    own = F.coalesce(*[F.when(F.col("bid") == i, vec.linear(F.col("x"), w)) for i, w in enumerate(ws)])
    return vec.reduce_vectors(each.select("id", own.alias("x")), ["id"], "x", len(ws[0]), "mean")


def rgat(relations: DataFrame, x: DataFrame, heads: Sequence[Sequence[tuple[Matrix, Sequence[float], Sequence[float]]]]) -> DataFrame:
    """(id, x): the mean over the relations into a target of gat() with the heads of each relation."""
    out = None
    for bid, own in enumerate(heads):
        part = gat(relations.where(F.col("bid") == bid), x, own)
        out = part if out is None else out.union(part)
    return vec.reduce_vectors(out, ["id"], "x", len(heads[0][0][0]), "mean")


#: A table of vectors is broadcast up to so many numbers, 64 MB.
BROADCAST = 1 << 23


def hetero_conv(relations: DataFrame, x: DataFrame, dim: int, shared: DataFrame | None = None, once: bool = False) -> DataFrame:
    """(id, x): for each relation (bid) the mean of the sources' features by target, summed over
    relations and divided by the number of relations into the target. One plan for all relations. With
    `once`, an edge of a relation counts once however often it is given.

    With `shared`, a table of vectors (v, x), nodes are given as (id, v): edges are joined with v by source
    and shuffled once by target, as numbers alone; repeated edges go, sources are counted by v and vectors
    are looked up and summed behind that, so a busy target adds up as many vectors as there are at most.
    That shuffle keeps its number of partitions: Spark joins small ones by what they hold before, and
    sums of so many targets in one task would go to disk. The table is broadcast up to BROADCAST numbers,
    whatever spark.sql.autoBroadcastJoinThreshold is, as the join would shuffle a vector for each count
    otherwise; with a larger one it does."""
    edges = relations.select("bid", "src", "dst")
    if shared is not None:
        n = int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        index = x.select(F.col("id").alias("src"), "v")
        if once:  # a node that is given more than once counts as often, as in a join with distinct edges
            index = index.withColumn("_copy", F.row_number().over(Window.partitionBy("src").orderBy("v")) - 1)
        edge = ["src", "_copy"] if once else []
        found = edges.join(index, "src").select("bid", F.col("dst").alias("id"), "v", *edge).repartition(n, "id")
        counts = found.groupBy("bid", "id", "v").agg((F.count_distinct(*edge) if once else F.count("*")).alias("_c"))
        table, few = shared.select("v", "x"), BROADCAST // dim
        met = counts.join(F.broadcast(table) if table.limit(few + 1).count() <= few else table, "v")
        each = met.groupBy("bid", "id").agg(F.sum("_c").alias("_n"), *[F.sum(F.col("x")[i] * F.col("_c")).alias(f"_{i}") for i in range(dim)])
        return vec.reduce_vectors(each.select("id", F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dim)]).alias("x")), ["id"], "x", dim, "mean")
    m = message.copy_u(edges.distinct() if once else edges, x).select("bid", F.col("dst").alias("id"), "x")
    each = vec.reduce_vectors(m, ["bid", "id"], "x", dim, "mean")
    return vec.reduce_vectors(each, ["id"], "x", dim, "mean")


def edge_predictor(pairs: DataFrame, x: DataFrame, w_src: Matrix, w_dst: Matrix, w_out: Sequence[float]) -> DataFrame:
    """Pairs with score: w_out relu(w_src h[src] + w_dst h[dst])."""
    a, b = x.select(F.col("id").alias("src"), F.col("x").alias("_a")), x.select(F.col("id").alias("dst"), F.col("x").alias("_b"))
    both = vec.relu(vec.add(vec.linear(F.col("_a"), w_src), vec.linear(F.col("_b"), w_dst)))
    return pairs.join(a, "src").join(b, "dst").withColumn("score", vec.dot(both, F.array(*[F.lit(float(v)) for v in w_out]))).drop("_a", "_b")


def node_classifier(x: DataFrame, w1: Matrix, w2: Matrix) -> DataFrame:
    """(id, p, label): a two-layer perceptron's probabilities and the best class, the first of equal ones."""
    p = vec.softmax(vec.linear(vec.relu(vec.linear(F.col("x"), w1)), w2))
    return x.select("id", p.alias("p")).withColumn("label", vec.argmax(F.col("p")))


def temporal_attention(sampled: DataFrame, roots: DataFrame, x: DataFrame, edge_x: DataFrame, w_q: Matrix, w_k: Matrix, w_v: Matrix, w_out: Matrix, heads: int, time_dim: int = 4, scale: float = 1e-9) -> DataFrame:
    """(root_id, x): attention of each root (root_id, x) over its sampled events (root_id, eid, nbr, dt).

    Queries come from the root's vector and the encoded gap 0; keys and values from the neighbour's
    vector (id, x), the event's (eid, x) and the encoded gap. What is attended and the root's vector
    pass a layer with relu and are normalised. A root without events attends nothing: zeros.
    """
    zero = vec.time_encoding(F.lit(0.0), time_dim)
    w_kv, n_k, n_v = [*w_k, *w_v], len(w_k), len(w_v)
    at = len(w_kv[0]) - time_dim
    last = [list(row[at:]) for row in w_kv]
    # each vector is multiplied by its columns of the weights where it stands once; products are joined
    near = x.select(F.col("id").alias("nbr"), vec.linear_part(F.col("x"), w_kv, F.lit(1)).alias("_n"))
    kind = edge_x.select("eid", vec.linear_part(F.col("x"), w_kv, at + 1 - F.size("x")).alias("_e"))
    own = roots.select("root_id", vec.linear(F.concat("x", zero), w_q).alias("q"), vec.linear(F.col("x"), [list(row[n_v:]) for row in w_out]).alias("_o"))
    rows = sampled.select("root_id", "eid", "nbr", "dt").join(near, "nbr").join(kind, "eid").join(own.select("root_id", "q"), "root_id")
    passed = vec.linear(vec.time_encoding(F.col("dt") * scale, time_dim), last)
    rows = rows.select(F.col("root_id").alias("dst"), "q", vec.add(vec.add(F.col("_n"), F.col("_e")), passed).alias("_kv"))
    got = attention(rows.select("dst", "q", F.slice("_kv", 1, n_k).alias("k"), F.slice("_kv", n_k + 1, n_v).alias("v")), heads, n_v).select(F.col("dst").alias("root_id"), F.col("x").alias("_a"))
    none = F.array(*[F.lit(0.0)] * n_v)
    out = own.select("root_id", "_o").join(got, "root_id", "left").select("root_id", vec.add(vec.linear(F.coalesce("_a", none), [list(row[:n_v]) for row in w_out]), F.col("_o")).alias("x"))
    return out.select("root_id", vec.layer_norm(vec.relu(F.col("x"))).alias("x"))


def cross_entropy(p: Column, label: Column) -> Column:
    return -F.log(F.greatest(F.get(p, label), F.lit(1e-12)))


def nll(log_p: Column, label: Column) -> Column:
    return -F.get(log_p, label)


def bce_with_logits(z: Column, label: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))
