"""Convolutions over node flows: layers of sampled neighbours, with skip connections and histories."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vectors as vec
from weftgraph.operators import message, sampling
from weftgraph.operators.layers import Matrix, dense, filled
from weftgraph.plans.lineage import cut


@dataclass
class Block:
    """Sampled edges (src, dst) into all nodes (id) of a layer."""

    edges: DataFrame
    nodes: DataFrame


@dataclass
class Step:
    """What follows an aggregate: w h + bias, then an activation; with `skip` the result is w h + bias
    and behind it the activation of that, so it is twice as long."""

    w: Matrix
    bias: Sequence[float] | None = None
    activation: Callable[[Column], Column] | None = None
    skip: bool = False

    @property
    def inputs(self) -> int:
        return len(self.w[0])

    @property
    def dim(self) -> int:
        return len(self.w) * (2 if self.skip else 1)

    @property
    def shortens(self) -> bool:
        return len(self.w) < self.inputs

    def before(self, h: DataFrame) -> DataFrame:
        """w h, where that is shorter than h; means and sums over neighbours are taken of it then."""
        return dense(h, self.w) if self.shortens else h

    @property
    def width(self) -> int:
        return len(self.w) if self.shortens else self.inputs

    def after(self, h: DataFrame) -> DataFrame:
        """of(), given what was made of before()."""
        return self.of(h, self.shortens)

    def of(self, h: DataFrame, multiplied: bool = False) -> DataFrame:
        bias = F.array(*[F.lit(float(b)) for b in self.bias or []])
        out = dense(h, self.w, self.bias) if not multiplied else h if self.bias is None else h.withColumn("x", vec.add(F.col("x"), bias))
        if self.activation is None:
            return out
        shown = self.activation(F.col("x"))
        return out.withColumn("x", F.concat("x", shown) if self.skip else shown)


def node_flow(edges: DataFrame, seeds: DataFrame, fans: Sequence[int], salt: int = 0, loops: bool = False) -> list[Block]:
    """Blocks from the outermost layer to the seeds (id): fans[0] in-neighbours at most of each seed,
    fans[1] of each of those, and so on, drawn by hash. With `loops` each node is among its own.

    Each layer is written once before the next is drawn, so the plan doesn't grow with the depth.
    Repeated seeds are one; nodes without neighbours stay in their layer.
    """
    nodes, flow = cut(seeds.select("id").distinct()), []
    for depth, fan in enumerate(fans):
        near = sampling.neighbours(edges, nodes, fan, salt + depth, into=True).select(F.col("nbr").alias("src"), F.col("seed").alias("dst"))
        if loops:
            near = near.union(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
        flow.append(Block(cut(near), nodes))
        nodes = cut(flow[-1].edges.select(F.col("src").alias("id")).distinct())
    return flow[::-1]


def sampled_gcn(flow: Sequence[Block], x: DataFrame, steps: Sequence[Step], before: Step | None = None) -> DataFrame:
    """(id, x) of the seeds: in each block the mean over sampled neighbours, then its step; `before` is
    taken of the features alone. Nodes without neighbours have zeros for a mean."""
    h = x.select("id", "x") if before is None else before.of(x.select("id", "x"))
    for block, step in zip(flow, steps, strict=True):
        h = step.after(filled(message.spmm(block.edges, step.before(h), step.width, how="mean"), block.nodes, step.width))
    return h


def full_gcn(edges: DataFrame, x: DataFrame, steps: Sequence[Step], norms: DataFrame | None = None, before: Step | None = None) -> DataFrame:
    """(id, x) of all nodes, what sampled_gcn() estimates: the sum over all neighbours times the node's
    norm (id, norm), by default one over its in-degree, then the step, for each step."""
    norms = edges.groupBy(F.col("dst").alias("id")).agg((1.0 / F.count("*")).alias("norm")) if norms is None else norms
    h = x.select("id", "x") if before is None else before.of(x.select("id", "x"))
    for step in steps:
        scaled = message.spmm(edges, step.before(h), step.width).join(norms, "id").select("id", vec.scale(F.col("x"), F.col("norm")).alias("x"))
        h = step.after(filled(scaled, x, step.width))
    return h


def history_gcn(flow: Sequence[Block], edges: DataFrame, x: DataFrame, histories: Sequence[DataFrame], steps: Sequence[Step], before: Step | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """((id, x) of the seeds, new histories): as sampled_gcn(), with control variates.

    A block takes the mean over sampled neighbours of what changed since the step's history (id, x),
    plus the mean of the history over all neighbours. The new histories have what the flow's nodes
    gave each step and the old rows of all others; they are made when they are read. Nodes without a history start from zeros.
    """
    h = x.select("id", "x") if before is None else before.of(x.select("id", "x"))
    kept = []
    for block, step, old in zip(flow, steps, histories, strict=True):
        dim = step.inputs
        sources = block.edges.select(F.col("src").alias("id")).distinct()
        h = cut(h.join(sources, "id", "left_semi"))
        zero = F.array(*[F.lit(0.0)] * dim)
        change = h.join(old.select("id", F.col("x").alias("_o")), "id", "left").select("id", vec.sub(F.col("x"), F.coalesce("_o", zero)).alias("x"))
        part = filled(message.spmm(block.edges, step.before(change), step.width, how="mean"), block.nodes, step.width)
        into = edges.join(block.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        whole = _mean_with_gaps(into, step.before(old.select("id", "x")), step.width)
        both = part.join(whole.select("id", F.col("x").alias("_w")), "id", "left")
        kept.append(old.select("id", "x").join(h, "id", "left_anti").union(h.select("id", "x")))
        none = F.array(*[F.lit(0.0)] * step.width)
        h = step.after(both.select("id", vec.add(F.col("x"), F.coalesce("_w", none)).alias("x")))
    return h, kept


def _mean_with_gaps(edges: DataFrame, x: DataFrame, dim: int) -> DataFrame:
    """The mean over all neighbours, where those without a vector count as zeros."""
    n = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return message.spmm(edges, x, dim).join(n, "id").select("id", vec.scale(F.col("x"), 1 / F.col("n")).alias("x"))


def batch_stats(x: DataFrame, dim: int) -> DataFrame:
    """One row (mean, var): of each place of the vectors, over all rows."""
    places = [F.col("x")[i] for i in range(dim)]
    return x.agg(F.array(*map(F.avg, places)).alias("mean"), F.array(*map(F.var_pop, places)).alias("var"))


def batch_norm(x: DataFrame, stats: DataFrame, gamma: Sequence[float] | None = None, beta: Sequence[float] | None = None, eps: float = 1e-5) -> DataFrame:
    """x with each place shifted and scaled by the row of batch_stats(), of this table or, at inference,
    of another, then by gamma and beta."""
    column = lambda v: F.array(*[F.lit(float(c)) for c in v])
    unit = F.zip_with(vec.sub(F.col("x"), F.col("mean")), "var", lambda v, s: v / F.sqrt(s + eps))
    out = unit if gamma is None else vec.mul(unit, column(gamma))
    out = out if beta is None else vec.add(out, column(beta))
    return x.crossJoin(F.broadcast(stats)).withColumn("x", out).drop("mean", "var")  # one row


def gin_batch(edges: DataFrame, x: DataFrame, first: Step, second: Step, eps: float = 0.0) -> DataFrame:
    """(id, x): (1 + eps) x + mean of the neighbours, then twice a layer, a batch norm over all nodes and
    relu. What a norm's statistics and rows share is written once."""
    near = filled(message.spmm(edges, x, first.inputs, how="mean"), x, first.inputs).withColumnRenamed("x", "_m")
    h = x.join(near, "id").select("id", vec.add(vec.scale(F.col("x"), F.lit(1.0 + eps)), F.col("_m")).alias("x"))
    for step in (first, second):
        h = cut(step.of(h))
        h = batch_norm(h, batch_stats(h, step.dim)).withColumn("x", vec.relu(F.col("x")))
    return h
