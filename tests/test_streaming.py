"""The scoring plan on a parquet stream gives the batch answer."""

import os

from pyspark.sql import functions as F

from concord.operators import evaluate as E
from concord.plans import fixtures as fx
from concord.streaming import score_stream

from conftest import SF_SMALL

W = [3.0, -2.0, 0.1]


def test_stream_scoring_equals_batch(spark, scratch):
    src = os.path.join(scratch, "src")
    fx.cls_small(spark, SF_SMALL).write.parquet(src)
    batch = fx.cls_small(spark, SF_SMALL)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (score_stream(stream, (W, "logistic")).select("l_orderkey", "l_linenumber", "score", "prediction")
         .writeStream.format("memory").queryName("scored").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored").agg(F.count("*").alias("n"), F.sum("score").alias("s"),
                                                F.sum("prediction").alias("p")).first()
    want = E.predict(batch, W, "logistic").agg(F.count("*").alias("n"), F.sum("score").alias("s"),
                                               F.sum("prediction").alias("p")).first()
    assert got["n"] == want["n"] and abs(got["s"] - want["s"]) < 1e-6 and got["p"] == want["p"]
