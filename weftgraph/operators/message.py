"""Message passing: edges (src, dst, ...), node features (id, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vectors as vec
from weftgraph.operators.structure import degrees
from weftgraph.plans import ranges


def copy_u(edges: DataFrame, x: DataFrame) -> DataFrame:
    """Edges with x, the source's vector."""
    return edges.join(x.select(F.col("id").alias("src"), "x"), "src")


def u_add_v(edges: DataFrame, u: DataFrame, v: DataFrame, out: str = "e") -> DataFrame:
    """Edges with the sum of the source's and the target's number (id, value)."""
    a, b = u.select(F.col("id").alias("src"), F.col("value").alias("_u")), v.select(F.col("id").alias("dst"), F.col("value").alias("_v"))
    return edges.join(a, "src").join(b, "dst").withColumn(out, F.col("_u") + F.col("_v")).drop("_u", "_v")


def u_mul_e(edges: DataFrame, x: DataFrame, weight: Column) -> DataFrame:
    """Edges with x, the source's vector times the edge's weight."""
    return copy_u(edges.withColumn("_w", weight), x).withColumn("x", vec.scale(F.col("x"), F.col("_w"))).drop("_w")


#: Scores whose exponentials are summed in relation to one number differ by this at most.
STEP = 16.0


def edge_softmax(edges: DataFrame, score: str, by: tuple[str, ...] = ("dst",), out: str = "alpha") -> DataFrame:
    """Edges with the softmax of score over the edges into a target (of a relation, of a head).

    Scores are summed by steps of STEP first, each step's exponentials in relation to its upper end, so
    nothing overflows and no maximum has to be known before. A target's few steps then give its sum in
    relation to its highest one, which is joined once. Both sums combine before the shuffle, so a
    target with very many edges is never gathered. Null scores have no part in it and stay null."""
    step = F.floor(F.col(score) / STEP)
    parts = edges.where(F.col(score).isNotNull()).groupBy(*by, step.alias("_step")).agg(F.sum(F.exp(F.col(score) - (step + 1) * STEP)).alias("_part"))
    whole = parts.groupBy(*by).agg(F.max("_step").alias("_high"), F.collect_list(F.struct("_step", "_part")).alias("_parts"))
    scaled = F.transform("_parts", lambda p: p["_part"] * F.exp((p["_step"] - F.col("_high")) * STEP))
    sums = whole.select(*by, ((F.col("_high") + 1) * STEP).alias("_end"), vec.total(scaled).alias("_sum"))
    return edges.join(sums, list(by), "left").withColumn(out, F.exp(F.col(score) - F.col("_end")) / F.col("_sum")).drop("_end", "_sum")


def softmax_sums(rows: DataFrame, by: tuple[str, ...], score: str, value: str, heads: int, dim: int) -> DataFrame:
    """(by..., x): of rows with the arrays `score`, a number for each head, and `value`, `dim` numbers for
    each head, the sum of the values weighted by each head's softmax over the rows of `by`.

    Weights and weighted values are summed by steps of the scores, as in edge_softmax(), in one aggregate
    for all heads: no row is multiplied by the heads, and none is joined with its sums. Steps are centred
    at 0, so that small scores of all heads share one. Null scores have no part."""
    s = rows.withColumn("_steps", F.transform(score, lambda v: F.floor(v / STEP + 0.5)))
    s = s.withColumn("_e", F.zip_with(score, "_steps", lambda v, k: F.exp(v - k * STEP)))
    each = [F.sum(F.col("_e")[h]).alias(f"_w{h}") for h in range(heads)] + [F.sum(F.col("_e")[i // dim] * F.col(value)[i]).alias(f"_v{i}") for i in range(heads * dim)]
    part = s.groupBy(*by, "_steps").agg(*each)
    items = [F.struct(F.lit(h).alias("_head"), F.col("_steps")[h].alias("_step"), F.array(f"_w{h}", *[f"_v{h * dim + i}" for i in range(dim)]).alias("_p")) for h in range(heads)]
    part = part.select(*by, F.explode(F.array(*items)).alias("_i")).select(*by, "_i.*").where("_step is not null")
    part = vec.reduce_vectors(part, [*by, "_head", "_step"], "_p", dim + 1)
    few = part.groupBy(*by, "_head").agg(F.max("_step").alias("_high"), F.collect_list(F.struct("_step", "_p")).alias("_parts"))
    scaled = F.transform("_parts", lambda p: vec.scale(p["_p"], F.exp((p["_step"] - F.col("_high")) * STEP)))
    sums = few.select(*by, "_head", F.aggregate(scaled, F.array(*[F.lit(0.0)] * (dim + 1)), vec.add).alias("_p"))
    one = sums.select(*by, F.struct("_head", F.transform(F.slice("_p", 2, dim), lambda v: v / F.col("_p")[0]).alias("x")).alias("_x"))
    return one.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_x")), lambda p: p["x"])).alias("x"))


def aggregate(messages: DataFrame, dim: int, how: str = "sum") -> DataFrame:
    """(id, x): messages reduced by target."""
    return vec.reduce_vectors(messages.select(F.col("dst").alias("id"), "x"), ["id"], "x", dim, how)


def spmm(edges: DataFrame, x: DataFrame, dim: int, weight: Column | None = None, how: str = "sum") -> DataFrame:
    """(id, x): the sparse matrix of the edges times the features."""
    return aggregate(copy_u(edges, x) if weight is None else u_mul_e(edges, x, weight), dim, how)


def spmm_grad_edges(edges: DataFrame, x: DataFrame, grad: DataFrame) -> DataFrame:
    """Edges with grad_w, the derivative by the edge's weight: dot(grad[dst], x[src])."""
    g = grad.select(F.col("id").alias("dst"), F.col("x").alias("_g"))
    return copy_u(edges, x).join(g, "dst").withColumn("grad_w", vec.dot(F.col("_g"), F.col("x"))).drop("_g", "x")


def spmm_grad_nodes(edges: DataFrame, grad: DataFrame, dim: int, weight: Column | None = None) -> DataFrame:
    """(id, x): the derivative by the sources' features: the reversed graph's product."""
    turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return spmm(turned, grad, dim, weight)


def gat_scores(edges: DataFrame, q: DataFrame, k: DataFrame, slope: float = 0.2, by: tuple[str, ...] = ("dst",)) -> DataFrame:
    """Edges with alpha: softmax over a target's edges of leaky_relu(q[dst] + k[src])."""
    e = u_add_v(edges, k, q, "_s").withColumn("_s", vec.leaky_relu(F.col("_s"), slope))
    return edge_softmax(e, "_s", by).drop("_s")


def gat_grad(scored: DataFrame, grad: str, slope: float = 0.2, by: tuple[str, ...] = ("dst",)) -> DataFrame:
    """Edges with grad_s, the derivative by q + k given that by alpha; needs raw (q + k) and alpha."""
    inner = scored.groupBy(*by).agg(F.sum(F.col(grad) * F.col("alpha")).alias("_i"))
    e = scored.join(inner, list(by))
    return e.withColumn("grad_s", F.col("alpha") * (F.col(grad) - F.col("_i")) * F.when(F.col("raw") < 0, slope).otherwise(1.0)).drop("_i")


def gcn_weights(edges: DataFrame, vertices: DataFrame, norm: str = "both") -> DataFrame:
    """Edges with w: both: 1 / sqrt(out(src) in(dst)); right: 1 / in(dst); left: 1 / out(src);
    root: sqrt(out(src) in(dst)); none: 1. Degrees count 1 at least."""
    d = degrees(edges, vertices)
    a = d.select(F.col("id").alias("src"), F.greatest("out_degree", F.lit(1)).alias("_o"))
    b = d.select(F.col("id").alias("dst"), F.greatest("in_degree", F.lit(1)).alias("_i"))
    w = {"both": 1 / F.sqrt(F.col("_o") * F.col("_i")), "right": 1 / F.col("_i"), "left": 1 / F.col("_o"), "root": F.sqrt(F.col("_o") * F.col("_i")), "none": F.lit(1.0)}[norm]
    return edges.join(a, "src").join(b, "dst").withColumn("w", w).drop("_o", "_i")


def weight_grad(inputs: DataFrame, grad: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row, col, grad): the derivative by a matrix (rows, cols) that inputs (id, x) of `cols` numbers
    are multiplied by, given that by the products, grad (id, x) of `rows` numbers: the sum over nodes
    of outer products. A node gives `rows` blocks of one row each, which are summed by row before the
    shuffle, so a task sends on `rows` vectors whatever the number of nodes. Nodes that stand on one
    side only give nothing."""
    both = inputs.select("id", F.col("x").alias("_x")).join(grad.select("id", F.col("x").alias("_g")), "id")
    blocks = both.select(F.posexplode("_g").alias("row", "_v"), "_x").select("row", vec.scale(F.col("_x"), F.col("_v")).alias("x"))
    return vec.reduce_vectors(blocks, ["row"], "x", cols).select(F.col("row").cast("long").alias("row"), F.posexplode("x").alias("col", "grad")).withColumn("col", F.col("col").cast("long"))


def fold_weights(edges: DataFrame, decay: float = 0.5) -> DataFrame:
    """Edges (src, dst) with w, what ordered_fold() weighs a message by: places need no vectors."""
    placed = ranges.placed(edges.select("src", "dst"), ["dst"], ["src"], "_i", "_n")
    return placed.select("src", "dst", F.pow(F.lit(decay), F.col("_n") - F.col("_i") - 1).alias("w"))


def ordered_fold(messages: DataFrame, dim: int, decay: float = 0.5) -> DataFrame:
    """(id, x): a recurrent reducer, h = decay * h + x over a target's messages by source. The fold
    is a weighted sum with weights from places counted backwards, so it needs no sequential task."""
    placed = ranges.placed(messages.select("src", "dst", "x"), ["dst"], ["src"], "_i", "_n")
    return aggregate(placed.withColumn("x", vec.scale(F.col("x"), F.pow(F.lit(decay), F.col("_n") - F.col("_i") - 1))), dim)
