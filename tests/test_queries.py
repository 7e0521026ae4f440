"""Every registered query of the graph engine against its SQL."""

import pytest

from tests.conftest import same_rows
from weftgraph.catalog import QUERIES, SQL
from weftgraph.operators import partition
from weftgraph.sources.graphs import part_graph


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df())


def test_balanced_parts(spark, sf_dir):
    rows = QUERIES["r2_balanced_parts"](spark, sf_dir).toPandas()
    assert rows["id"].is_unique and set(rows["part"]) <= {0, 1, 2, 3}
    assert rows.groupby("part").size().max() <= 1.1 * -(-len(rows) // 4)
    edges = part_graph(spark, sf_dir).toPandas()
    part, ranked = dict(zip(rows["id"], rows["part"])), {i: n for n, i in enumerate(sorted(rows["id"]))}
    cut = sum(part[a] != part[b] for a, b in zip(edges["src"], edges["dst"]))
    size = -(-len(rows) // 4)
    assert cut < sum(ranked[a] // size != ranked[b] // size for a, b in zip(edges["src"], edges["dst"]))


@pytest.mark.parametrize("rounds", [1, 2, 3, 8])
def test_balanced_parts_of_a_wanted_part(spark, rounds):
    """Everybody's neighbours are in one part, which takes no more than it has room for, in any round."""
    edges = spark.createDataFrame([(i, i % 5, 1) for i in range(5, 100)], "src long, dst long, w long")
    rows = partition.balanced_parts(edges, spark.range(100), 4, rounds).toPandas()
    assert sorted(rows["id"]) == list(range(100)) and rows.groupby("part").size().max() <= 27
    start = sum(i // 25 != i % 5 // 25 for i in range(5, 100))
    part = dict(zip(rows["id"], rows["part"]))
    assert sum(part[i] != part[i % 5] for i in range(5, 100)) <= start
