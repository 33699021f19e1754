"""Streams: bounded reordering, gaps, and flows that are drained, stopped or fail."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.streaming import strips
from tessera.streaming.flow import Cancelled, Flow

TILE = "slide_id long, idx long, nbytes long"


def stored(spark, folder, rows):
    spark.createDataFrame(rows, TILE).coalesce(1).write.parquet(f"{folder}/in")
    return lambda s: s.readStream.schema(TILE).parquet(f"{folder}/in")


def test_the_buffer_is_bounded(spark, tmp_path):
    rows = [(1, i, i) for i in range(20, 0, -1)]
    late = stored(spark, f"{tmp_path}/a", rows)
    seen = []
    flow = Flow(late, lambda df: strips.in_order(df, most=30), lambda df, n: seen.extend(df.collect()), f"{tmp_path}/a/c")
    flow.run(spark)
    assert seen == []
    tight = Flow(late, lambda df: strips.in_order(df, most=5), lambda df, n: df.collect(), f"{tmp_path}/b/c")
    with pytest.raises(Exception, match="wait for tile 0"):
        tight.run(spark)


def test_flow_drains_and_goes_on(spark, tmp_path):
    source = stored(spark, str(tmp_path), [(1, i, 10 * i) for i in range(6)])
    seen = []
    Flow(source, lambda df: df.where("idx > 1"), lambda df, n: seen.extend(r.idx for r in df.collect()), f"{tmp_path}/c").run(spark)
    assert sorted(seen) == [2, 3, 4, 5]
    spark.createDataFrame([(1, 9, 0)], TILE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    Flow(source, lambda df: df.where("idx > 1"), lambda df, n: seen.extend(r.idx for r in df.collect()), f"{tmp_path}/c").run(spark)
    assert sorted(seen) == [2, 3, 4, 5, 9]


def test_flow_is_cancelled(spark, tmp_path):
    source = stored(spark, str(tmp_path), [(1, i, 0) for i in range(3)])
    flow = Flow(source, lambda df: df, lambda df, n: flow.cancel(), f"{tmp_path}/c")
    with pytest.raises(Exception) as raised:
        flow.run(spark)
    assert flow.stopped and (isinstance(raised.value, Cancelled) or "stopp" in str(raised.value).lower())

    def broken(df, n):
        raise ValueError("the sink is full")

    with pytest.raises(Exception, match="the sink is full"):
        Flow(source, lambda df: df, broken, f"{tmp_path}/d").run(spark)


def test_missing(spark):
    tiles = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 0), (2, 1), (3, 0), (3, 0)], "slide_id long, idx long")
    expected = spark.createDataFrame([(1, 4), (2, 2), (3, 2), (4, 1)], "slide_id long, n long")
    assert sorted(tuple(r) for r in strips.missing(tiles, expected).collect()) == [(1, 4, 3, 2), (3, 2, 1, 1), (4, 1, 0, 0)]


@pytest.mark.parametrize("ids", [range(5), range(6), range(7), [0, 2, 3, 9, 10, 16]])
def test_strips_equal_sql_at_any_end(spark, tmp_path, ids):
    """Tables whose last band is not full, or in which rows are missing or have no vector."""
    rows = [(i, [(64 * i + k) / 1000 for k in range(64)], 0) for i in ids] + [(8, None, 0)] * (9 in ids)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.queries()["strip_stream_pyramid"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = db.execute(f"select {', '.join(found.columns)} from ({catalog.oracle_sql()['strip_stream_pyramid']}) q").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted) and wanted


def test_strips_over_many_batches(spark, tmp_path):
    """Rows of 5 pixels, one to a batch, with a known end and without one: the edges are repeated, or black."""
    image = np.random.default_rng(5).integers(0, 256, (7, 5, 3))
    for y in (3, 0, 6, 1, 5, 2, 4):
        spark.createDataFrame([(y, *image[y].T.tolist())], "y long, r array<int>, g array<int>, b array<int>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    due = table.groupBy(F.floor(F.col("y") / 4).cast("long").alias("band")).agg(F.count(F.lit(1)).alias("due"))
    for height, mode in ((7, "edge"), (None, "constant")):
        rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        made = strips.pyramid_stream(rows, height, 2, None if height else due)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/{mode}").option("checkpointLocation", f"{tmp_path}/{mode}-state").trigger(availableNow=True).start().awaitTermination()
        wanted, raster = [], image
        for level in (1, 2):
            raster = strips.halved(np.pad(raster, ((0, raster.shape[0] % 2), (0, raster.shape[1] % 2), (0, 0)), mode=mode))
            wanted += [(y * 2**level // 4, level, x, y, *raster[y, x].tolist()) for y, x in np.ndindex(raster.shape[:2])]
        assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{mode}").collect()) == sorted(wanted)
