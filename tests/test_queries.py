"""Registered queries of the voxel engine against their SQL on the small tables."""

import os

import pytest

from fractus import registry, split_queries  # noqa: F401  the second adds its queries to the first

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def asked(sql):
    """The rows of a statement; up to four times, as DuckDB 2.0.0 fails now and then within recursions by an internal error."""
    duckdb = pytest.importorskip("duckdb")
    for left in range(3, -1, -1):
        con = duckdb.connect()
        for name in os.listdir(SF):
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
        try:
            return con.execute(sql).df()
        except duckdb.InternalException:
            if not left:
                raise


def same(frame, other):
    names = sorted(frame.columns)
    assert names == sorted(other.columns)
    ordered = [df[names].astype(str).sort_values(names).reset_index(drop=True) for df in (frame, other)]
    assert ordered[0].equals(ordered[1])


#: A minute each; their parts are compared with dense grids in test_plans.py.
SLOW = set() if os.environ.get("SLOW_TESTS") else {"augmented_seeds", "coarse_split", "geodesic_split_plain", "least_paths", "repaired_labels", "ridge_seeds"}


@pytest.mark.parametrize("name", sorted(registry.SQL.keys() - SLOW))
def test_against_sql(spark, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), asked(registry.SQL[name]))


def test_without_sql(spark):
    tree = registry.QUERIES["seed_spanning_tree"](spark, SF).toPandas()
    assert len(tree) == 25 - len(tree.groupby(["sv_id", "side"]))  # each side of each fragment is one tree
    split = registry.QUERIES["geodesic_split"](spark, SF).toPandas()
    assert (split.n_source + split.n_sink + split.n_stray).sum() == 7244 and (split.n_sink > 0).all()
    repaired = registry.QUERIES["resolved_labels"](spark, SF).toPandas()
    assert (repaired.n_source + repaired.n_sink + repaired.n_stray).sum() == 7244
    joined = registry.QUERIES["ridge_seeds"](spark, SF).toPandas()
    assert len(joined) == 10 and (joined.n >= 2).all()
    flooded = registry.QUERIES["watershed_split"](spark, SF).toPandas()
    assert (flooded.n_source > 0).all() and (flooded.n_sink > 0).all() and (flooded.n_stray == 0).all()
