"""Block assignment and placement: skew handling, one block per partition, lambda grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import blocks as B
from concord.plans import fixtures as fx

from conftest import SF_SMALL


def test_row_hash_blocks_spread_identical_copies(spark):
    # a third of the rows are exact copies of one row: content hashing would put them in one block
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("k"))
    sizes = [r["n_rows"] for r in B.block_sizes(B.assign_blocks(df, 6)).collect()]
    assert len(sizes) == 6 and max(sizes) < 700


def test_split_hot_blocks_keeps_every_row(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") % 4).cast("int").alias("block_id"),
                                  F.col("id"))
    out = B.split_hot_blocks(df, max_rows=1000)
    sizes = {r["block_id"]: r["n_rows"] for r in B.block_sizes(out).collect()}
    assert sum(sizes.values()) == 5000 and max(sizes.values()) <= 1100
    assert out.select("id").distinct().count() == 5000


@pytest.fixture()
def coalescing(spark):
    """Adaptive execution lowers the number of shuffle partitions differently per plan."""
    conf = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled_rows(spark):
    return (fx.reg_small(spark, SF_SMALL).groupBy("l_orderkey")
            .agg(F.avg("label").alias("label"), F.first("features").alias("features"), F.count(F.lit(1)).alias("k")))


def test_blocks_by_place_lose_no_row_of_a_shuffled_input(spark, coalescing):
    from concord.plans.train import place

    df = shuffled_rows(spark)
    n = df.count()
    placed = place(B.assign_blocks(df, 400), 2)
    assert placed.n_rows == n and placed.payload.agg(F.sum("n")).first()[0] == n
    placed.release()
    gram = place(B.assign_blocks(df, 400), 2, gram=True)
    assert gram.payload.agg(F.sum("n")).first()[0] == n and gram.payload.count() == gram.n_blocks
    gram.release()


def test_split_of_a_shuffled_input_loses_no_row(spark, coalescing):
    df = shuffled_rows(spark).withColumn("block_id", F.pmod("l_orderkey", F.lit(5)).cast("int"))
    out = B.split_hot_blocks(df, 3)
    assert out.count() == df.count() == B.block_sizes(out).agg(F.sum("n_rows")).first()[0]
    assert B.block_sizes(out).agg(F.max("n_rows")).first()[0] < 20


def test_rows_without_block_or_label_are_refused(spark):
    from concord.plans.train import train_regression

    rows = [(0, 1.0, [1.0]), (1, 2.0, [2.0])]
    schema = "block_id int, label double, features array<double>"
    for bad in [(None, 1.0, [1.0]), (0, None, [1.0]), (0, float("nan"), [1.0])]:
        with pytest.raises(ValueError):
            train_regression(spark.createDataFrame([*rows, bad], schema), 1, max_iter=1)
    with pytest.raises(ValueError):
        train_regression(spark.createDataFrame([], schema), 1, max_iter=1)


def test_a_payload_that_changes_when_read_again_is_refused(spark):
    import pyarrow as pa

    from concord.plans.train import place

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(np.random.default_rng().random(batch.num_rows) < 0.5))

    df = spark.range(400).select((F.col("id") % 5).cast("int").alias("block_id"), F.lit(1.0).alias("label"), F.array(F.lit(1.0)).alias("features"))
    with pytest.raises(RuntimeError):
        for _ in range(5):
            place(df.mapInArrow(some, df.schema), 1).release()


def test_one_key_input_is_split_and_trains(spark):
    from concord.plans.train import train_regression

    df = fx.reg_small(spark, SF_SMALL).withColumn("block_id", F.lit(0))
    m = train_regression(df, 2, lam=0.5, rho=0.5, max_iter=40, max_block_rows=1000)
    assert m.n_blocks >= 5


def test_blocks_follow_the_input_bytes(spark):
    df = fx.table(spark, SF_SMALL, "lineitem")
    assert B.blocks_for(df) == 1 and B.blocks_for(df, block_bytes=10_000) > 5


@pytest.mark.parametrize("n", [4, 1000])
def test_pass_moves_only_the_state(spark, n):
    """No exchange above the cached payload in the plan of a pass."""
    from concord.plans.admm import STATE_SCHEMA, make_pass_function
    from concord.plans.train import ls_update, place

    placed = place(fx.reg_small(spark, SF_SMALL, n_blocks=n), 2, gram=True)
    state = placed.payload.select(F.col("block_id").alias("b")).distinct().select(
        F.col("b").alias("block_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("x"), F.array(F.lit(0.0), F.lit(0.0)).alias("y"))
    fn = make_pass_function(ls_update(2, "gram"), 2, np.zeros(2), 2.0, None)
    out = placed.payload.groupBy("block_id").cogroup(state.groupBy("block_id")).applyInArrow(fn, STATE_SCHEMA)
    plan = out._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "FlatMapCoGroupsInArrow" in plan and "Exchange" not in plan
    assert out.count() == placed.n_blocks
    placed.release()


def test_packing_is_independent_of_block_count(spark):
    import pyarrow as pa

    from concord.operators.solvers import pack_rows, unpack_block

    rng = np.random.default_rng(1)
    n = 500
    ids = rng.integers(0, 300, n).astype(np.int32)
    X = rng.normal(size=(n, 3))
    table = pa.table({"block_id": pa.array(ids), "label": pa.array(X[:, 0]), "features": pa.array(list(X))})
    packed = pa.Table.from_batches([pack_rows(table, "dense", 3)])
    assert packed.num_rows == len(set(ids)) and packed.column("n").to_numpy().sum() == n
    for i, b in enumerate(packed.column("block_id").to_pylist()):
        got, y = unpack_block(packed.slice(i, 1), "dense", 3)
        np.testing.assert_array_equal(got, X[ids == b])
        np.testing.assert_array_equal(y, X[ids == b, 0])


def test_lambda_grid(spark):
    from concord.plans.train import lambda_grid

    g = [r["lambda"] for r in lambda_grid(spark, 1000).orderBy("i").collect()]
    assert len(g) == 50 and g[0] == pytest.approx(1000.0) and g[-1] == pytest.approx(1.0)
    np.testing.assert_allclose(np.diff(np.log(g)), np.log(1e-3) / 49)


def test_split_keeps_rows_where_they_lie(spark):
    """The sizes of the blocks go to the rows: a block's rows never meet in one task, whatever the join threshold is."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = B.split_hot_blocks(spark.range(0, 1000, 1, 7).withColumn("block_id", (F.col("id") % 2).cast("int")), 100)
        assert out.rdd.getNumPartitions() == 7
        assert out.count() == 1000 and B.block_sizes(out).count() == 10
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
