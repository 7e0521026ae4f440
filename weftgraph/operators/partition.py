"""Partitions of vertices and edges, halos and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.structure import neighbourhood, numbered, row_pointers
from weftgraph.plans import ranges
from weftgraph.plans.lineage import cut, stored


def range_part(id_: Column, size: int, parts: int) -> Column:
    """Blocks of `size` ids; what is left over goes to the last part."""
    return F.least(F.floor(id_ / size), F.lit(parts - 1)).cast("long")


def hash_part(id_: Column, parts: int, salt: int = 0) -> Column:
    return ((id_ * 2654435761 + salt) % 2147483629 % parts).cast("long")


def with_halo(edges: DataFrame, assigned: DataFrame, hops: int) -> DataFrame:
    """(part, id, inner): each part's vertices and those within `hops` in-edges of them.

    assigned: (id, part). All parts grow at the same time, keyed by part.
    """
    found = assigned.select("part", "id")
    for _ in range(hops):
        step = found.join(edges.select(F.col("dst").alias("id"), "src"), "id").select("part", F.col("src").alias("id"))
        found = found.union(step).distinct()
    own = assigned.select("part", "id", F.lit(True).alias("inner"))
    return found.join(own, ["part", "id"], "left").select("part", "id", F.coalesce("inner", F.lit(False)).alias("inner"))


def edge_parts(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Edges with part (that of the target) and cut (ends in different parts)."""
    a, b = assigned.select(F.col("id").alias("src"), F.col("part").alias("_ps")), assigned.select(F.col("id").alias("dst"), "part")
    return edges.join(a, "src").join(b, "dst").withColumn("cut", F.col("_ps") != F.col("part")).drop("_ps")


def metrics(edges: DataFrame, assigned: DataFrame, hops: int = 1) -> DataFrame:
    """(part, inner, total, edges, cut) of each part; total counts the halo."""
    halo = with_halo(edges, assigned, hops).groupBy("part").agg(F.sum(F.col("inner").cast("long")).alias("inner"), F.count("*").alias("total"))
    cuts = edge_parts(edges, assigned).groupBy("part").agg(F.count("*").alias("edges"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return halo.join(cuts, "part", "left").fillna(0, ["edges", "cut"])


def bounded_parts(edges: DataFrame, vertices: DataFrame, most: int) -> DataFrame:
    """(id, part): ranges of vertices with about `most` out-edges each, by the edges before them."""
    return row_pointers(edges, vertices).select("id", F.floor(F.col("start") / most).alias("part"))


def closure_parts(edges: DataFrame, seeds: DataFrame, parts: int, hops: int, salt: int = 0) -> DataFrame:
    """(part, id): seeds dealt out by hash, each part closed over `hops` in-edges."""
    assigned = seeds.select("id", hash_part(F.col("id"), parts, salt).alias("part"))
    return with_halo(edges, assigned, hops).select("part", "id")


def training_graph(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Edges of the seeds' neighbourhood whose target is at most hops - 1 away."""
    inner = neighbourhood(edges, seeds, hops - 1)
    return edges.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def renumbered(assigned: DataFrame) -> DataFrame:
    """(id, part, new): vertices (id, part) numbered so that a part's numbers follow each other, parts
    in their order and vertices by id within; numbered range by range."""
    return numbered(assigned.select("id", "part"), "part", "id")


def partition_book(new: DataFrame) -> DataFrame:
    """(part, first, n): the range of numbers of each part of renumbered() vertices."""
    return new.groupBy("part").agg(F.min("new").alias("first"), F.count("*").alias("n"))


def part_of(new: Column, book: list[tuple[int, int]]) -> Column:
    """The part of a number by a book of (first, part), which has a row a part and is a literal: the
    last part that begins at or before it."""
    rows = sorted(book)
    begun = F.size(F.filter(F.array(*[F.lit(first) for first, _ in rows]), lambda first: first <= new))
    return F.element_at(F.array(*[F.lit(part).cast("long") for _, part in rows]), begun)


def local_vertices(edges: DataFrame, new: DataFrame, hops: int) -> DataFrame:
    """(part, local, id, new, inner): each part's own vertices and its halo with numbers from 0 in the
    part: own ones first, in their order, then the halo by its new numbers. new: renumbered().

    Own vertices take their numbers from the book; a halo's are places that are counted over ranges, as
    the halo of a part can hold most of the graph.
    """
    book = partition_book(new).select("part", "first", "n")
    own = new.join(F.broadcast(book), "part").select("part", (F.col("new") - F.col("first")).alias("local"), "id", "new", F.lit(True).alias("inner"))  # a row a part
    far = with_halo(edges, new.select("id", "part"), hops).where("not inner").select("part", "id").join(new.select("id", "new"), "id")
    placed = ranges.placed(far, ["part"], ["new"], "_i").join(F.broadcast(book), "part")
    return own.unionByName(placed.select("part", (F.col("n") + F.col("_i")).alias("local"), "id", "new", F.lit(False).alias("inner")))


def local_edges(edges: DataFrame, local: DataFrame) -> DataFrame:
    """Edges with part (that of the target's own part) and local_src, local_dst: their ends' numbers in
    it. local: local_vertices() of a hop at least."""
    dst = local.where("inner").select(F.col("id").alias("dst"), "part", F.col("local").alias("local_dst"))
    src = local.select("part", F.col("id").alias("src"), F.col("local").alias("local_src"))
    return edges.join(dst, "dst").join(src, ["part", "src"])


def write_local_parts(edges: DataFrame, features: DataFrame, local: DataFrame, path: str) -> None:
    """A partitioned graph: tables `vertices` (part, local, id, new, inner), `edges` (part, local_src,
    local_dst, ...) and `features` (part, local, x) of own vertices, each with a folder for each part
    and sorted by local number, and `book` (part, first, n)."""
    vertices = local.select("part", "local", "id", "new", "inner")
    own = vertices.where("inner")
    found = {"vertices": vertices, "edges": local_edges(edges, local).drop("src", "dst"), "features": own.select("part", "local", "id").join(features.select("id", "x"), "id").drop("id")}
    for name, rows in found.items():
        by = "local_dst" if name == "edges" else "local"
        rows.repartitionByRange("part", by).sortWithinPartitions("part", by).write.partitionBy("part").parquet(f"{path}/{name}")
    partition_book(own.select("part", "new")).write.parquet(f"{path}/book")


def load_part(spark: SparkSession, path: str, part: int) -> dict[str, DataFrame]:
    """The tables of one part; only its folders are read. Global ids are in `vertices`."""
    return {name: spark.read.parquet(f"{path}/{name}").where(F.col("part") == part) for name in ("vertices", "edges", "features")}


def load_book(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, part) of all parts, for part_of(); a row a part."""
    return [(r["first"], r["part"]) for r in spark.read.parquet(f"{path}/book").collect()]


def feature_slices(features: DataFrame, parts: int, dim: int) -> DataFrame:
    """(id, part, x): feature vectors cut into `parts` runs, the last with what is left over."""
    size = dim // parts
    cuts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.cast("long").alias("part"), F.slice("x", p * size + 1, F.when(p == parts - 1, dim - p * size).otherwise(size)).alias("x")))
    return features.select("id", F.explode(cuts).alias("c")).select("id", "c.*")


def first_fit(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Bins for a handful of relations: largest first, each into the first bin with room."""
    room: list[int] = []
    found = {}
    for name in sorted(sizes, key=lambda n: (-sizes[n], n)):
        place = next((i for i, r in enumerate(room) if r >= sizes[name]), None)
        if place is None:
            room.append(most)
            place = len(room) - 1
        room[place] -= sizes[name]
        found[name] = place
    return found


def balanced_parts(edges: DataFrame, vertices: DataFrame, parts: int, rounds: int = 8, slack: float = 0.1) -> DataFrame:
    """(id, part): ranges of ids to start with, then vertices move to where most of their neighbours
    are, and no part ever holds more than (1 + slack) times its share.

    In each round only moves in one direction are taken, from lower to higher parts or the other way
    by turns, so that neighbours don't change places with each other. A vertex asks for the part that
    gains it most edges within parts. A part admits by gain, then by id, exactly as many as it has
    room for before anyone leaves; places among the applicants are counted over ranges, so a part that
    everybody wants is no single task. A round whose moves cut more edges than before, which moves of
    neighbours at the same time can do, isn't taken, and two such rounds end it. So the cut never grows.
    """
    n = vertices.count()
    size = -(-n // parts) if n else 1
    most = int(size * (1 + slack))
    now = cut(vertices.select("id", range_part(F.col("id").cast("long"), 1, 1).alias("part")) if parts == 1 else numbered(vertices.select("id"), "id").select("id", F.least(F.floor(F.col("new") / size), F.lit(parts - 1)).cast("long").alias("part")))
    edges = stored(edges.select("src", "dst"))  # each round reads them twice
    both = edges.where("src != dst").select("src", "dst").union(edges.where("src != dst").select(F.col("dst"), F.col("src"))).toDF("src", "dst")
    crossing = lambda p: edge_parts(edges.select("src", "dst"), p).where("cut").count()
    cuts, idle = crossing(now), 0
    for turn in range(rounds):
        votes = both.join(now.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.count("*").alias("n"))
        known = votes.join(now, "id")
        here = known.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("to") == F.col("part"), F.col("n"))), F.lit(0)).alias("_here"))
        way = F.col("to") > F.col("part") if turn % 2 == 0 else F.col("to") < F.col("part")
        best = known.where(way).groupBy("id").agg(F.max(F.struct("n", (-F.col("to")).alias("t"))).alias("b"))
        asks = best.join(here, "id").select("id", (-F.col("b.t")).alias("to"), (F.col("b.n") - F.col("_here")).alias("gain")).where("gain > 0")
        room = now.groupBy(F.col("part").alias("to")).agg((F.lit(most) - F.count("*")).alias("_room"))
        placed = ranges.placed(asks.withColumn("_loss", -F.col("gain")), ["to"], ["_loss", "id"], "_i")
        # a part without vertices has all its room
        fit = placed.join(F.broadcast(room), "to", "left").where(F.col("_i") < F.coalesce("_room", F.lit(most))).select("id", F.col("to").alias("_to"))
        then = cut(now.join(fit, "id", "left").select("id", F.coalesce("_to", "part").alias("part")))
        crossed = crossing(then)
        idle = 0 if crossed < cuts else idle + 1
        if crossed < cuts:
            now, cuts = then, crossed
        if idle == 2:
            break
    return now
