"""Merkle manifest of a data set by time-forward processing: digests go up to parents in the order of
node labels, proofs come down to leaves in the reverse order.

A tree is cut into blocks of 2 ** bits neighbouring nodes of a level and what lies above them, up to
the block's top. Between blocks, Spark's sorted, spilling shuffle is the external part of the queue:
messages carry their receiver's block and place. Within a block, whose size is bounded, a heap delivers
messages by node label. So n leaves take log(n) / bits rounds each way, and no task holds more than one
block, however large a tree is.
"""

from __future__ import annotations

from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import table
from weftgraph.plans.lineage import stored

#: Levels of a block, which has 2 ** BITS leaves at most.
BITS = 12
#: Marks of a proof's steps: the sibling stands left or right, or there's none.
LEFT, RIGHT, ALONE = "l", "r", "-"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field_digest(*fields: Column) -> Column:
    """The digest of the fields: each `-` if null, else the bytes of its text, a colon and the text."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in text]), 256)


def widths(n: int, levels: int | None) -> list[int]:
    """Nodes of each level of a block with n leaves: `levels` above the leaves, or as many as lead to
    one node."""
    out = [n]
    while len(out) <= levels if levels is not None else out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out


def ascend(leaves: list[str], levels: int | None) -> list[str]:
    """Digests of a block's nodes by label: leaves first, then level by level.

    Nodes are worked off by label; a node takes what its children have sent off the queue, and sends
    its digest to its parent, whose label is larger.
    """
    sizes = widths(len(leaves), levels)
    begins = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    if len(sizes) == 1:
        return list(leaves)
    out: list[str] = []
    queue: list[tuple[int, int, str]] = []  # receiver, sender, digest
    for level, size in enumerate(sizes):
        for i in range(size):
            label = begins[level] + i
            if level:
                parts = []
                while queue and queue[0][0] == label:
                    parts.append(heappop(queue)[2])
                out.append(digest("".join(parts)))
            else:
                out.append(leaves[i])
            if level + 1 < len(sizes):
                heappush(queue, (begins[level + 1] + i // 2, label, out[label]))
    return out


def descend(nodes: list[str], n: int, levels: int | None, suffix: list[str]) -> list[list[str]]:
    """Proofs of a block's n leaves, from the digests of its nodes and its top's proof: the sweep of
    ascend() backwards, in which a node sends each child the proof from there on."""
    sizes = widths(n, levels)
    begins = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    level_of = {begins[i] + k: i for i, size in enumerate(sizes) for k in range(size)}
    out: list[list[str]] = [[] for _ in range(n)]
    queue = [(-(begins[-1] - 1), suffix)]
    while queue:
        label, proof = heappop(queue)
        level = level_of[-label]
        if level == 0:
            out[-label] = proof
            continue
        first = begins[level - 1] + 2 * (-label - begins[level])
        if first + 1 < begins[level]:
            heappush(queue, (-(first + 1), [LEFT + nodes[first], *proof]))
            heappush(queue, (-first, [RIGHT + nodes[first + 1], *proof]))
        else:
            heappush(queue, (-first, [ALONE, *proof]))
    return out


def fold(leaf: str, proof: list[str]) -> str:
    """The root that a leaf and a proof lead to."""
    for step in proof:
        other = step[1:]
        leaf = digest(other + leaf if step[0] == LEFT else leaf + other)
    return leaf


def number(rows: DataFrame, *order: str) -> DataFrame:
    """rows (_t, ...) with pos, their place in their tree by `order` (nulls first), and n, the tree's
    size. Rows are dealt by ranges of tree and order and counted by range, so a tree that holds most
    rows is spread over as many tasks as its rows need. `order` must tell all rows apart."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = stored(rows.repartitionByRange("_t", *keys).withColumn("_p", F.spark_partition_id()))
    counts, tree = ranged.groupBy("_t", "_p").agg(F.count("*").alias("_c")), Window.partitionBy("_t")
    base = counts.select("_t", "_p", (F.sum("_c").over(tree.orderBy("_p")) - F.col("_c")).alias("_base"), F.sum("_c").over(tree).alias("n"))
    place = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_t", "_p").orderBy(*keys)) - 1)
    return place.join(base, ["_t", "_p"]).withColumn("pos", F.col("_base") + F.col("_r")).drop("_p", "_r", "_base")


def _taker(bits: int):
    """The function that gives a block's top."""

    def take(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n = rows["n"][0].as_py()
        top = ascend(rows["digest"].to_pylist(), bits if n > 1 << bits else None)[-1]
        return pa.table({"_t": [key[0].as_py()], "_b": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "digest": [top]})

    return take


def tree_tops(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of nodes (_t, pos, n, digest, ...) the nodes of each round, with their block _b, and the tops
    (_t, top) of the trees that end in each round."""
    most, side = nodes.agg(F.max("n")).first()[0], 1 << bits
    levels, tops = [], []
    while most:
        now = stored(nodes.withColumn("_b", F.shiftright("pos", bits)))
        up = stored(now.groupBy("_t", "_b").applyInArrow(_taker(bits), "_t string, _b long, n long, digest string"))
        levels.append(now)
        tops.append(up.where(F.col("n") <= side).select("_t", F.col("digest").alias("top")))
        nodes = up.where(F.col("n") > side).select("_t", F.col("_b").alias("pos"), F.ceil(F.col("n") / side).alias("n"), "digest")
        most = -(-most // side) if most > side else 0
    return levels, tops


def _sender(shown: bool, bits: int):
    """The function that gives a block's nodes their proofs and roots, and folds what they show."""

    def send(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        size = bits if nodes["n"][0].as_py() > 1 << bits else None
        leaves = nodes["digest"].to_pylist()
        found = descend(ascend(leaves, size), len(leaves), size, above["proof"][0].as_py())
        out = nodes.drop_columns(["_b"]).append_column("proof", pa.array(found, pa.list_(pa.string())))
        for name in ("top", "root"):
            out = out.append_column(name, pa.array(above[name].to_pylist() * len(leaves), pa.string()))
        if shown:
            out = out.append_column("folded_root", pa.array([fold(a, b) for a, b in zip(nodes["shown"].to_pylist(), found, strict=True)], pa.string()))
        return out

    return send


def proofs(levels: list[DataFrame], tops: list[DataFrame], given: DataFrame, bits: int) -> DataFrame:
    """Nodes of the first round with proof, root and, where they have `shown`, folded_root: `given`
    (_t, proof, root) holds each tree's own. A block gets one row from the round above it."""
    down = None
    for k in range(len(levels) - 1, -1, -1):
        incoming = tops[k].join(given, "_t").select("_t", F.lit(0).cast("long").alias("_b"), "proof", "top", "root")
        incoming = incoming if down is None else incoming.unionByName(down.select("_t", F.col("pos").alias("_b"), "proof", "top", "root"))
        fields = [f for f in levels[k].schema.fields if f.name != "_b"]
        shown = any(f.name == "shown" for f in fields)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", proof array<string>, top string, root string" + ", folded_root string" * shown
        down = levels[k].groupBy("_t", "_b").cogroup(incoming.groupBy("_t", "_b")).applyInArrow(_sender(shown, bits), schema)
        down = stored(down) if k else down
    return down


def merkle_manifest(docs: DataFrame, fields: list[str], by: str, order: str, shown: Column | None = None, bits: int = BITS) -> DataFrame:
    """(<order>, leaf, shown, subroot, root, proof, folded_root, verified): of each row of docs the
    digest of its fields (field_digest), the root over the rows of the same `by`, the root over all
    those, and its proof, from the row up: `l` or `r` and the digest of the sibling on that side, `-`
    where there's none. folded_root is what `shown`, a digest (by default the leaf), leads to along
    the proof; verified says whether that is the root.

    In a group rows ascend by `order`, nulls first, then by leaf, so ties and repeated rows have a
    place each and equal trees have equal roots; groups ascend by the bytes of their text, null first.
    Two neighbours have the digest of both digests as parent, a last one alone that of its own. A
    group of one row has that row's leaf as its subroot, and a single group's subroot is the root. Null
    fields count as `-`, empty texts as `0:`. Texts are read once and don't leave the JVM. Other columns
    don't count, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    leaf = field_digest(*[F.col(f"`{c}`") for c in fields])
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{by}`").cast("string")), F.lit(""))
    slim = docs.select(tree.alias("_t"), F.col(f"`{order}`").alias("_key"), leaf.alias("digest"), (leaf if shown is None else F.coalesce(shown, leaf)).alias("shown"))
    slim = stored(slim.withColumn("_i", F.monotonically_increasing_id()))  # tells equal rows apart, once written
    levels, tops = tree_tops(number(slim, "_key", "digest", "_i").drop("_i"), bits)
    if not levels:
        none = F.lit(None).cast("string")
        return slim.select(F.col("_key").alias(order), F.col("digest").alias("leaf"), "shown", none.alias("subroot"), none.alias("root"), F.array().cast("array<string>").alias("proof"), none.alias("folded_root"), F.lit(False).alias("verified"))
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    over = number(subroots.select(F.lit("").alias("_t"), F.col("_t").alias("_key"), F.col("top").alias("digest")), "_key")
    high, root = tree_tops(over, bits)
    given = spark.createDataFrame([("", [])], "_t string, proof array<string>").join(root[-1], "_t").select("_t", "proof", F.col("top").alias("root"))
    above = stored(proofs(high, root, given, bits).select(F.col("_key").alias("_t"), "proof", "root"))
    out = proofs(levels, tops, above, bits)
    return out.select(F.col("_key").alias(order), F.col("digest").alias("leaf"), "shown", F.col("top").alias("subroot"), "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str, bits: int = BITS) -> DataFrame:
    """merkle_manifest() of all documents by language, in which documents whose checksum 7 divides show
    one character more than they had (those without an id or a count stay). Nulls, empty texts,
    repeats, an empty table and further columns as stated there."""
    docs = table(spark, sf_dir, "documents")
    tampered = field_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered)
    found = merkle_manifest(docs, FIELDS, "lang", "doc_id", shown, bits)
    siblings = F.concat_ws("", F.transform("proof", lambda step: F.substring(step, 2, 64)))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


#: The checksum goes bit by bit over the digits of doc_id; trees are lists of digests, halved until one
#: is left; a proof reads the sibling of each level, and the shown leaf is folded level by level.
OP11_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS t, sha256({" || ".join(_field(c) for c in FIELDS)}) AS leaf,
  sha256({" || ".join(_field("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS)}) AS other,
  list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END) AS crc FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN other ELSE leaf END AS shown FROM d),
lt AS (SELECT t, 0 AS lv, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY t
  UNION ALL SELECT t, lv + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(array_to_string(nodes[i : i + 1], ''))) FROM lt WHERE len(nodes) > 1),
lm AS MATERIALIZED (SELECT * FROM lt),
st AS MATERIALIZED (SELECT t, lv AS depth, nodes[1] AS subroot, row_number() OVER (ORDER BY t) - 1 AS pos FROM lm WHERE len(nodes) = 1),
rt AS (SELECT 0 AS lv, list(subroot ORDER BY pos) AS nodes FROM st UNION ALL SELECT lv + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(array_to_string(nodes[i : i + 1], ''))) FROM rt WHERE len(nodes) > 1),
rm AS MATERIALIZED (SELECT * FROM rt),
root AS (SELECT nodes[1] AS root FROM rm WHERE len(nodes) = 1),
steps AS MATERIALIZED (SELECT rid, lv, (pos >> lv) % 2 AS side, coalesce(nodes[xor(pos >> lv, 1) + 1], '') AS sib FROM p JOIN lm USING (t) WHERE len(nodes) > 1
  UNION ALL SELECT rid, depth + lv, (st.pos >> lv) % 2, coalesce(nodes[xor(st.pos >> lv, 1) + 1], '') FROM p JOIN st USING (t), rm WHERE len(nodes) > 1),
fl AS (SELECT rid, 0 AS lv, shown AS h FROM p UNION ALL SELECT fl.rid, fl.lv + 1, sha256(CASE WHEN s.side = 1 THEN s.sib || fl.h ELSE fl.h || s.sib END) FROM fl JOIN steps s ON s.rid = fl.rid AND s.lv = fl.lv),
fd AS MATERIALIZED (SELECT rid, arg_max(h, lv) AS folded FROM fl GROUP BY rid),
pr AS (SELECT rid, string_agg(sib, '' ORDER BY lv) AS sibs FROM steps GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM p JOIN st USING (t) JOIN fd USING (rid) LEFT JOIN pr USING (rid), root"""
