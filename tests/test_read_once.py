"""Tables read several times are computed once; rows of two tables are dealt once."""

import pytest
from pyspark.sql import functions as F

from flowmill.catalog import compare, generate, models, quality as quality_queries
from flowmill.operators import quality as Q
from flowmill.plans import neighbours
from flowmill.session import stored


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_views_read_several_times_have_no_joins_left(spark, sf):
    frames = [*compare._pair(spark, sf), *quality_queries._perturbed(spark, sf), generate._bootstrap(spark, sf)[0],
              generate._real(spark, sf), *models._parts(spark, sf)]
    assert not any("Join" in _plan(df) for df in frames)


def test_stored_rows_are_the_same(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', -0.0D, array(1)), (null, null, double('nan'), null) AS t(i, `b c`, x, l)")
    assert sorted(map(str, stored(df).collect())) == sorted(map(str, df.collect()))
    assert stored(df.limit(0)).count() == 0 and stored(df).schema.names == df.schema.names
    assert stored(df.withColumn("nothing", F.lit(None))).count() == 2


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_membership_by_few_and_many_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "MAX_SHARED_FINGERPRINTS", most)
    real = spark.createDataFrame([(i % 7, float(i % 5), None if i % 3 else "x") for i in range(90)], "a int, b double, c string")
    made = spark.createDataFrame([(1, 1.0, "x"), (1, 1.0, "x"), (2, -0.0, None), (3, 9.0, None), (None, None, None)] + [
        (i, float(i), "x") for i in range(5)], "a int, b double, c string")
    hit, new = Q.exact_matches(made, real), Q.novel_rows(made, real)
    known = {(r.a, r.b, r.c) for r in real.collect()}
    want = [r for r in made.collect() if (r.a, r.b, r.c) in known]
    assert sorted(map(str, hit.collect())) == sorted(map(str, want)) and new.count() == made.count() - len(want)
    # Cells are no keys of the join: tables are dealt by fingerprint.
    assert "hashpartitioning(a" not in hit._jdf.queryExecution().executedPlan().toString()
    row = Q.duplicate_rows(real.unionByName(made)).first()
    rows = [(r.a, r.b, r.c) for r in real.unionByName(made).collect()]
    assert (row.rows, row.distinct_rows, row.duplicate_rows) == (100, len(set(rows)), 100 - len(set(rows)))
    assert tuple(Q.duplicate_rows(real.limit(0)).first()) == (0, 0, 0)


def test_blocks_of_neighbours_are_dealt_as_tiles():
    assert neighbours.tile_side(10, 10, 200) == 1  # few visits leave a tile for every task
    assert neighbours.tile_side(1_000, 1_000, 200) == neighbours.MAX_TILE
    assert 1 < neighbours.tile_side(100, 100, 200) < neighbours.MAX_TILE
