"""What scratch tables leave behind, and what travels with the places in leaves."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from embralign.llm import _base, near_dedup


def shuffles(spark) -> int:
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")


def test_shuffles_go_once_their_table_is_written(spark):
    scratch, before = _base.Scratch(spark, "test"), shuffles(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    scratch.table(rows.repartition(3, "n"), "rows")
    until = time.time() + 20
    while shuffles(spark) > before and time.time() < until:  # removal isn't waited for
        time.sleep(0.1)
    assert shuffles(spark) <= before
    assert spark.conf.get(_base._CLEANUP) == "false"
    assert int(spark.conf.get(_base._BATCH).rstrip("b")) <= _base.BATCH_BYTES


def test_short_sketches_lose_no_agreement():
    m = np.random.default_rng(3).integers(0, 1 << 32, (5, near_dedup.SKETCH), dtype=np.uint32)
    m[1, :50] = m[0, :50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([9] * 5, pa.int64()), pa.array([x.tobytes() for x in m], pa.binary())], names=["rep", "n_shingles", "sketch"])
    (out,) = near_dedup._short(iter([batch]))
    short = np.frombuffer(b"".join(out.column("sketch").to_pylist()), np.uint8).reshape(5, -1)
    assert short.shape == (5, near_dedup.SKETCH)
    assert (short[0] == short[1]).sum() >= 50 > 38 > (short[0] == short[2]).sum()
