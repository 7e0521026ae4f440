from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftgraph.functions import vectors as vec
from weftgraph.operators import layers, memory, partition, sampling, state, temporal
from weftgraph.plans.lineage import shared_dir
from weftgraph.queries import query
from weftgraph.sources import temporal_store
from weftgraph.sources.graphs import EVENT_GRAPH, KINDS, PART_GRAPH, SEEDS, event_graph, features, part_graph, part_vertices, seeds

EV = f"WITH {EVENT_GRAPH}"
DAY = 86_400_000_000
MIX = "({} * 2654435761 + {} * 40503 + {}) % 2147483629"


def _roots(e):
    return e.select(F.col("eid").alias("root_id"), F.col("src").alias("node"), F.col("ts").alias("root_ts"))


RECENT = "rc AS (SELECT r.eid AS root_id, e.eid, e.dst AS nbr, e.ts, r.ts - e.ts AS dt, row_number() OVER (PARTITION BY r.eid ORDER BY e.ts DESC, e.eid DESC) AS rank FROM ev r JOIN ev e ON e.src = r.src AND e.ts < r.ts)"


@query("n6_recent", f"{EV}, {RECENT} SELECT root_id, CAST(rank AS INTEGER) AS rank, eid, nbr, ts, dt FROM rc WHERE rank <= 3")
def n6(spark, d):
    e = event_graph(spark, d)
    return temporal.recent(e, _roots(e), 3)



@query("n7_uniform", f"""{EV}, p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, eid) - 1 AS pos FROM ev),
c AS (SELECT r.eid AS root_id, r.src, (SELECT count(*) FROM ev x WHERE x.src = r.src AND x.ts < r.ts) AS n FROM ev r),
dr AS (SELECT root_id, src, k AS draw, {MIX.format('root_id', 'k', 0)} % n AS pos FROM c, (SELECT unnest(range(1, 4)) AS k) WHERE n > 0)
SELECT root_id, CAST(draw AS INTEGER) AS draw, eid, dst AS nbr, ts FROM dr JOIN p ON p.src = dr.src AND p.pos = dr.pos""")
def n7(spark, d):
    e = event_graph(spark, d)
    return temporal.uniform(e, _roots(e), 3).select("root_id", "draw", "eid", "nbr", "ts")


@query("n8_snapshots", f"""{EV}, m AS (SELECT r.eid AS root_id, CAST((r.ts - e.ts) // {7 * DAY} AS BIGINT) AS w, e.eid, e.dst AS nbr, e.ts FROM ev r JOIN ev e ON e.src = r.src
  WHERE r.ts - e.ts > 0 AND r.ts - e.ts < {21 * DAY} AND (r.ts - e.ts) % {7 * DAY} <> 0)
SELECT root_id, w AS window, CAST(rank AS INTEGER) AS rank, eid, nbr, ts FROM (SELECT *, row_number() OVER (PARTITION BY root_id, w ORDER BY ts DESC, eid DESC) AS rank FROM m) WHERE rank <= 2""")
def n8(spark, d):
    e = event_graph(spark, d)
    return temporal.snapshots(e, _roots(e), 2, 3, 7 * DAY)


@query("n10_second_hop", f"""{EV}, {RECENT}, b AS (SELECT * FROM rc WHERE rank <= 2), t AS (SELECT eid AS e2, dst AS node, src AS back, ts FROM ev)
SELECT root_id, eid, e2 FROM (SELECT b.root_id, b.eid, t.e2, row_number() OVER (PARTITION BY b.root_id, b.eid ORDER BY t.ts DESC, t.e2 DESC) AS k FROM b JOIN t ON t.node = b.nbr AND t.ts < b.ts) WHERE k <= 2""")
def n10(spark, d):
    e = event_graph(spark, d)
    roots = _roots(e)
    first = temporal.recent(e, roots, 2)
    nxt = temporal.second_hop(first, roots, keep_root_time=False)
    back = e.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "ts")
    hop = temporal.recent(back, nxt.select("root_id", "node", "root_ts"), 2)
    return hop.join(nxt.select("root_id", "parent", "via"), "root_id").select(F.col("parent").alias("root_id"), F.col("via").alias("eid"), F.col("eid").alias("e2"))


@query("p18_split", f"{EV}, q AS (SELECT min(ts) + (max(ts) - min(ts)) * 7 // 10 AS a, min(ts) + (max(ts) - min(ts)) * 85 // 100 AS b FROM ev) SELECT eid, CASE WHEN ts < a THEN 'train' WHEN ts < b THEN 'val' ELSE 'test' END AS split FROM ev, q")
def p18(spark, d):
    return _split(event_graph(spark, d)).select("eid", "split")


def _split(e):
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    return temporal.chronological_split(e, lo + (hi - lo) * 7 // 10, lo + (hi - lo) * 85 // 100)


@query("p19_inductive", f"{EV}, q AS (SELECT min(ts) + (max(ts) - min(ts)) * 7 // 10 AS a, min(ts) + (max(ts) - min(ts)) * 85 // 100 AS b FROM ev), tr AS (SELECT src AS id FROM ev, q WHERE ts < a UNION SELECT dst FROM ev, q WHERE ts < a) SELECT eid FROM ev, q WHERE ts < b OR src NOT IN (SELECT id FROM tr) OR dst NOT IN (SELECT id FROM tr)")
def p19(spark, d):
    return temporal.inductive(_split(event_graph(spark, d))).select("eid")


@query("p20_batches", f"{EV} SELECT eid, CAST((row_number() OVER (ORDER BY ts, eid) - 1) // 600 AS BIGINT) AS batch FROM ev")
def p20(spark, d):
    return temporal.batches(event_graph(spark, d), 600).select("eid", "batch")


@query("p21_shifted_batches", f"{EV}, i AS (SELECT eid, row_number() OVER (ORDER BY ts, eid) - 1 AS i FROM ev), d AS (SELECT k AS epoch, {MIX.format('k', 7, 0)} % 8 * 75 AS shift FROM (SELECT unnest(range(0, 5)) AS k)) SELECT eid, epoch, CAST(floor((i - shift) / 600) AS BIGINT) AS batch FROM i, d")
def p21(spark, d):
    return temporal.epoch_batches(event_graph(spark, d), 600, 8, 5, 7).select("eid", "epoch", "batch")


@query("p25_distinct_roots", f"{EV} SELECT DISTINCT dst, ts // {DAY} AS day FROM ev")
def p25(spark, d):
    return event_graph(spark, d).select("dst", F.expr(f"ts div {DAY}").alias("day")).dropDuplicates()


@query("n12_negatives", f"{EV} SELECT eid, CAST(j AS INTEGER) AS j, {MIX.format('eid', 'j', 17)} % (SELECT max(src) + 1 FROM ev) AS neg FROM ev, (SELECT unnest(range(1, 4)) AS j)")
def n12(spark, d):
    e = event_graph(spark, d)
    return sampling.negatives(e, e.agg(F.max("src") + 1).first()[0], 3, 17)


@query("n12_unseen_negatives", f"{EV}, q AS (SELECT min(ts) + (max(ts) - min(ts)) * 1 // 100 AS a FROM ev), tr AS (SELECT src AS id FROM ev, q WHERE ts < a UNION SELECT dst FROM ev, q WHERE ts < a), te AS (SELECT src AS id FROM ev, q WHERE ts >= a UNION SELECT dst FROM ev, q WHERE ts >= a), u AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM te WHERE id NOT IN (SELECT id FROM tr)), p AS (SELECT eid, CAST(j AS INTEGER) AS j, {MIX.format('eid', 'j', 23)} % (SELECT count(*) FROM u) AS i FROM ev, q, (SELECT unnest(range(1, 3)) AS j) WHERE ts >= a) SELECT eid, j, id AS neg FROM p JOIN u USING (i)")
def n12_unseen(spark, d):
    """Random ends for the events after the first hundredth of the time, among nodes that it hasn't."""
    e = event_graph(spark, d)
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    split = temporal.chronological_split(e, at := lo + (hi - lo) * 1 // 100, at)
    return sampling.negatives_among(split.where("split = 'test'"), sampling.unseen_nodes(split), 2, 23)


SAMPLED = "SELECT src AS seed, dst AS nbr, row_number() OVER (PARTITION BY src ORDER BY (src * 2654435761 + dst * 40503 + {}) % 2147483629, dst) AS n FROM e"


@query("n1_neighbours", f"WITH {PART_GRAPH} SELECT seed, nbr FROM ({SAMPLED.format(3)}) WHERE n <= 3")
def n1(spark, d):
    return sampling.neighbours(part_graph(spark, d), part_vertices(spark, d), 3, 3)


@query("n4_in_neighbours", f"WITH {PART_GRAPH} SELECT seed, nbr FROM (SELECT dst AS seed, src AS nbr, row_number() OVER (PARTITION BY dst ORDER BY (dst * 2654435761 + src * 40503 + 3) % 2147483629, src) AS n FROM e) WHERE n <= 2")
def n4(spark, d):
    return sampling.neighbours(part_graph(spark, d), part_vertices(spark, d), 2, 3, into=True)


@query("n3_multi_hop", f"""WITH {PART_GRAPH}, a AS ({SAMPLED.format(1)}), b AS ({SAMPLED.format(2)}), s0 AS ({SEEDS}),
h1 AS (SELECT seed, nbr FROM a WHERE n <= 2 AND seed IN (SELECT id FROM s0)), s1 AS (SELECT id FROM s0 UNION SELECT nbr FROM h1)
SELECT 1 AS hop, seed, nbr FROM h1 UNION ALL SELECT 2, seed, nbr FROM b WHERE n <= 3 AND seed IN (SELECT id FROM s1)""")
def n3(spark, d):
    return sampling.multi_hop(part_graph(spark, d), seeds(spark, d), [2, 3])


@query("w7_cached_nodes", f"WITH {PART_GRAPH} SELECT p_partkey AS id, count(e.src) AS out_degree FROM part LEFT JOIN e ON e.src = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 300")
def w7(spark, d):
    return sampling.top_by_degree(part_graph(spark, d), part_vertices(spark, d), 300)


@query("n13_visits", f"WITH {PART_GRAPH}, c AS (SELECT dst, count(*) AS n FROM e GROUP BY dst), k AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM c), t AS (SELECT count(*) AS nodes, sum(n) AS visits FROM c) SELECT nodes, CAST(visits AS BIGINT) AS visits, CAST(ceil(nodes * 0.2) AS BIGINT) AS top_nodes, round((SELECT sum(n) FROM k WHERE r <= ceil(nodes * 0.2)) / visits, 6) AS hit_rate FROM t")
def n13(spark, d):
    v = sampling.visit_share(part_graph(spark, d).select(F.col("dst").alias("id")), 0.2)
    return v.withColumns({"hit_rate": F.round("hit_rate", 6), "top_nodes": F.col("top_nodes").cast("long")})


@query("s24_bucketed_as_of", f"{EV}, {RECENT} SELECT ev.eid AS root_id, ev.src AS node, ev.ts AS root_ts, rc.eid, rc.nbr, rc.ts FROM ev LEFT JOIN rc ON rc.root_id = ev.eid AND rc.rank = 1")
def s24(spark, d):
    """The event before each event of its node, from bucketed tables of both."""
    e, name = event_graph(spark, d), f"weft_{uuid.uuid4().hex}"
    temporal_store.save_events(e, f"{name}_events", 30 * DAY, 8)
    temporal_store.save_roots(_roots(e), f"{name}_roots", 30 * DAY, 8)
    return temporal_store.latest_before(spark, f"{name}_events", f"{name}_roots")


MAIL = "m AS (SELECT src AS node, dst AS peer, ts, eid, 0 AS side, w AS payload FROM ev UNION ALL SELECT dst, src, ts, eid, 1, w FROM ev)"


@query("st4_last_mail", f"{EV}, {MAIL} SELECT node, peer, ts, eid, payload FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, eid DESC, side DESC) AS k FROM m) WHERE k = 1")
def st4(spark, d):
    return state.last_mail(state.mails(event_graph(spark, d)))


@query("st6_mailbox", f"{EV}, {MAIL} SELECT node, peer, ts, eid, side, payload, CAST((i - 1) % 4 AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, eid, side) AS i, row_number() OVER (PARTITION BY node ORDER BY ts DESC, eid DESC, side DESC) AS k FROM m) WHERE k <= 4")
def st6(spark, d):
    return state.mailbox(state.mails(event_graph(spark, d)), 4).withColumn("slot", F.col("slot").cast("int"))


@query("st5_neighbour_mail", f"{EV}, {MAIL}, r AS (SELECT DISTINCT src AS node, dst AS nbr FROM ev) SELECT r.node, round(avg(payload), 6) AS payload, count(*) AS n FROM r JOIN m ON m.node = r.nbr GROUP BY r.node")
def st5(spark, d):
    e = event_graph(spark, d)
    out = state.deliver_to_neighbours(state.mails(e), e.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct())
    return out.withColumn("payload", F.round("payload", 6))


@query("st7_memory", f"{EV}, {MAIL} SELECT node, round(sum(payload * pow(0.5, k + 1)), 6) AS memory, max(ts) AS memory_ts FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, eid DESC, side DESC) - 1 AS k FROM m) GROUP BY node")
def st7(spark, d):
    return state.decayed_memory(state.mails(event_graph(spark, d))).withColumn("memory", F.round("memory", 6))


@query("st11_state_at", f"{EV}, {MAIL} SELECT e.eid AS label_id, e.src AS node, count(m.eid) AS n, round(coalesce(sum(m.payload), 0), 6) AS total FROM ev e LEFT JOIN m ON m.node = e.src AND m.ts < e.ts GROUP BY e.eid, e.src")
def st11(spark, d):
    e = event_graph(spark, d)
    times = e.select(F.col("eid").alias("label_id"), F.col("src").alias("node"), F.col("ts").alias("at"))
    return state.state_at(state.mails(e), times).withColumn("total", F.round("total", 6))


TIME, HEADS = 4, 2


def attention_weights(dim: int) -> tuple:
    """Fixed weights (query, key, value, out) over vectors of `dim`, an event's value and the time."""
    w = layers.weights
    return w(4, dim + TIME), w(4, dim + 1 + TIME, 2), w(4, dim + 1 + TIME, 5), w(4, 4 + dim, 3)


def _attention_parts(spark, d, k: int = 3):
    e, x = event_graph(spark, d), features(spark, d)
    n = x.agg(F.count("*").alias("n"))
    sampled = temporal.recent(e, _roots(e), k)
    own = e.crossJoin(F.broadcast(n)).select(F.col("eid").alias("root_id"), (F.col("src") % F.col("n")).alias("id")).join(x, "id").select("root_id", "x")
    return e, x.withColumn("id", F.col("id") + KINDS), sampled, own  # neighbours are types


@query("l11_temporal_attention")
def l11(spark, d):
    e, x, sampled, own = _attention_parts(spark, d)
    dim = len(x.first()["x"])
    out = layers.temporal_attention(sampled, own, x, e.select("eid", F.array("w").alias("x")), *attention_weights(dim), HEADS, TIME, 1e-12)
    return vec.long_form(out, ["root_id"], "x", 6)


@query("l12_snapshot_state")
def l12(spark, d):
    """Of each root the neighbours' mean vector in three weekly windows, put together by a recurrent cell."""
    e, x = event_graph(spark, d), features(spark, d)
    dim = len(x.first()["x"])
    y = layers.dense(x, layers.weights(4, dim)).select((F.col("id") + KINDS).alias("nbr"), "x")  # once a vector: means are linear
    near = temporal.snapshots(e, _roots(e), 2, 3, 7 * DAY).join(y, "nbr")
    steps = vec.reduce_vectors(near, ["root_id", "window"], "x", 4, "mean")
    return vec.long_form(memory.snapshot_state(steps, 3, 4, None, layers.weights(4, 4, 2)), ["root_id"], "x", 6)


CELL_DIM = 3


def cell(kind: str = "gru") -> memory.Cell:
    rows = CELL_DIM * (3 if kind == "gru" else 1)
    return memory.Cell(layers.weights(rows, 2 * CELL_DIM + 1 + 2), layers.weights(rows, CELL_DIM, 4), CELL_DIM, 2, 1e-12)


def _featured(e):
    return e.select("eid", "src", "dst", "ts", F.array(F.col("w") / 100).alias("feature"))


@query("st7_gru_memory")
def st7_gru(spark, d):
    return vec.long_form(memory.evolve(_featured(event_graph(spark, d)), 600, cell()), ["node", "memory_ts"], "memory")


@query("st7_rnn_memory")
def st7_rnn(spark, d):
    return vec.long_form(memory.evolve(_featured(event_graph(spark, d)), 600, cell("rnn")), ["node", "memory_ts"], "memory")


@query("st8_mailbox_attention")
def st8(spark, d):
    box = state.mailbox(state.mails(event_graph(spark, d)), 4).withColumn("payload", F.array(F.col("payload") / 100))
    start = memory.reset(box.select("node").distinct(), 4)
    w = layers.weights
    out = memory.attend_mailbox(box, start.withColumn("memory", F.transform(F.array(*map(F.lit, range(4))), lambda i: (F.pmod(F.col("node") + i, F.lit(7)) - 3) / 3.0)), 4, w(4, 4), w(4, 3, 2), w(4, 3, 5), w(4, 4, 3), 2, 2, 1e-12)
    return vec.long_form(out, ["node"], "memory")


for _how, _agg in (("mean", "avg(w)"), ("last", "arg_max(w, (rts, root_id))")):

    @query(f"st5_deliver_{_how}", f"""{EV}, {RECENT}, g AS (SELECT rc.root_id, rc.nbr, r.w, r.ts AS rts FROM rc JOIN ev r ON r.eid = rc.root_id WHERE rank <= 3)
SELECT nbr AS node, round({_agg}, 6) AS payload, count(*) AS n FROM g GROUP BY nbr""")
    def st5_deliver(spark, d, how=_how):
        e = event_graph(spark, d)
        mails = e.select(F.col("eid").alias("root_id"), "ts", F.col("w").alias("payload"))
        return memory.deliver(mails, temporal.recent(e, _roots(e), 3), how).withColumn("payload", F.round("payload", 6))


@query("st2_read_state", f"{EV}, m AS (SELECT src AS node, max(ts) AS ts FROM ev WHERE w > 50 GROUP BY src) SELECT eid, src AS node, coalesce(m.ts, 0) AS memory_ts FROM ev LEFT JOIN m ON m.node = src")
def st2(spark, d):
    e = event_graph(spark, d)
    new = e.where("w > 50").groupBy(F.col("src").alias("node")).agg(F.array(F.sum("w")).alias("memory"), F.max("ts").alias("memory_ts"))
    kept = memory.update_memory(memory.reset(e.select(F.col("src").alias("node")).distinct(), 1), new)
    return memory.read_state(kept, e.select("eid", F.col("src").alias("node")), 1).select("eid", "node", "memory_ts")


PARTS = f"WITH {PART_GRAPH}, a AS (SELECT p_partkey AS id, p_partkey * 2654435761 % 2147483629 % 4 AS part FROM part)"
HALO = "h AS (SELECT DISTINCT part, id FROM (SELECT part, id FROM a UNION ALL SELECT a.part, e.src FROM a JOIN e ON e.dst = a.id))"


def _assigned(spark, d):
    return part_vertices(spark, d).select("id", partition.hash_part(F.col("id"), 4).alias("part"))


@query("r5_halo", f"{PARTS}, {HALO} SELECT h.part, h.id, a.id IS NOT NULL AS inner FROM h LEFT JOIN a ON a.id = h.id AND a.part = h.part")
def r5(spark, d):
    return partition.with_halo(part_graph(spark, d), _assigned(spark, d), 1)


NEW = f"{PARTS}, {HALO}, nw AS (SELECT id, part, row_number() OVER (ORDER BY part, id) - 1 AS new FROM a), bk AS (SELECT part, min(new) AS first, count(*) AS n FROM nw GROUP BY part), lv AS (SELECT nw.part, new - first AS local, id, new, true AS inner FROM nw JOIN bk USING (part) UNION ALL SELECT h.part, bk.n + row_number() OVER (PARTITION BY h.part ORDER BY nw.new) - 1, h.id, nw.new, false FROM h JOIN nw ON nw.id = h.id AND nw.part <> h.part JOIN bk ON bk.part = h.part)"


@query("r5_local_vertices", f"{NEW} SELECT part, local, id, new, lv.inner AS inner FROM lv")
def r5_local(spark, d):
    return partition.local_vertices(part_graph(spark, d), partition.renumbered(_assigned(spark, d)), 1)


@query("r4_s16_stored_parts", f"{NEW} SELECT a.part, a.local AS local_dst, b.local AS local_src, a.id AS dst, b.id AS src, b.new AS new_src, s.part AS part_src FROM e JOIN lv a ON a.id = e.dst AND a.inner JOIN lv b ON b.part = a.part AND b.id = e.src JOIN nw s ON s.id = e.src WHERE a.part IN (1, 3)")
def r4_stored(spark, d):
    """Two stored parts' edges with the global ids of their ends, and the sources' parts by the book."""
    e = part_graph(spark, d)
    local = partition.local_vertices(e, partition.renumbered(_assigned(spark, d)), 1)
    partition.write_local_parts(e, features(spark, d), local, path := f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}")
    book, out = partition.load_book(spark, path), None
    for part in (1, 3):
        own = partition.load_part(spark, path, part)
        v = own["vertices"]
        found = own["edges"].join(v.select(F.col("local").alias("local_dst"), F.col("id").alias("dst")), "local_dst").join(v.select(F.col("local").alias("local_src"), F.col("id").alias("src"), F.col("new").alias("new_src")), "local_src")
        found = found.select(F.col("part").cast("long"), "local_dst", "local_src", "dst", "src", "new_src", partition.part_of(F.col("new_src"), book).alias("part_src"))
        out = found if out is None else out.unionByName(found)
    return out


@query("r8_metrics", f"{PARTS}, {HALO}, c AS (SELECT b.part, count(*) AS edges, sum(CASE WHEN a.part <> b.part THEN 1 ELSE 0 END) AS cut FROM e JOIN a ON a.id = src JOIN a b ON b.id = dst GROUP BY b.part) SELECT h.part, CAST(sum(CASE WHEN a.id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS inner, count(*) AS total, max(c.edges) AS edges, CAST(max(c.cut) AS BIGINT) AS cut FROM h LEFT JOIN a ON a.id = h.id AND a.part = h.part JOIN c ON c.part = h.part GROUP BY h.part")
def r8(spark, d):
    return partition.metrics(part_graph(spark, d), _assigned(spark, d))


@query("r6_bounded_parts", f"WITH {PART_GRAPH} SELECT id, CAST(coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 500 AS part FROM (SELECT p_partkey AS id, count(e.src) AS n FROM part LEFT JOIN e ON e.src = p_partkey GROUP BY 1)")
def r6(spark, d):
    return partition.bounded_parts(part_graph(spark, d), part_vertices(spark, d), 500)


@query("r1_closure_parts", f"WITH {PART_GRAPH}, a AS (SELECT p_partkey AS id, p_partkey * 2654435761 % 2147483629 % 3 AS part FROM part WHERE p_size <= 2) SELECT part, id FROM a UNION SELECT a.part, e.src FROM a JOIN e ON e.dst = a.id")
def r1(spark, d):
    return partition.closure_parts(part_graph(spark, d), seeds(spark, d), 3, 1)


@query("r7_training_graph", f"WITH {PART_GRAPH}, n0 AS ({SEEDS}), n1 AS (SELECT id FROM n0 UNION SELECT src FROM e WHERE dst IN (SELECT id FROM n0)) SELECT src, dst, w FROM e WHERE dst IN (SELECT id FROM n1)")
def r7(spark, d):
    return partition.training_graph(part_graph(spark, d), seeds(spark, d), 2)


@query("r2_balanced_parts")
def r2(spark, d):
    return partition.balanced_parts(part_graph(spark, d), part_vertices(spark, d), 4)
