"""Lineage cuts, their removal, folds and samples."""

import zlib

from pyspark.sql import functions as F

from rankloom.llm import shared


def test_cut_writes_and_clean_removes(spark):
    rows = shared.cut(spark.range(10).repartition(7), "test", parts=2)
    assert rows.count() == 10 and len(rows.inputFiles()) <= 2 and all(shared.run_dir(spark).removeprefix("file:").strip("/") in f for f in rows.inputFiles())
    empty = shared.cut(spark.range(0), "test")
    assert empty.count() == 0 and empty.columns == ["id"]
    shared.clean(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared.run_dir(spark))
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_held_out_is_crc32_of_the_id_as_text(spark):
    ids = [*range(200), -5, None]
    got = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", shared.held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_hash_share_is_even_and_stable(spark):
    df = spark.range(20_000).select(shared.hash_share(F.col("id"), F.lit(3)).alias("s"))
    assert 0.47 < df.where("s < 0.5").count() / 20_000 < 0.53 and df.agg(F.min("s"), F.max("s")).first()[0] >= 0


def test_row_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None), (2, "")], "i long, t string")
    keys = [r.k for r in df.select(shared.row_key(F.col("i"), F.col("t")).alias("k")).collect()]
    assert len(set(keys)) == 4 and keys[3] == keys[4]


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace

    import pytest

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared.shared_dir(SimpleNamespace(conf={}, sparkContext=context))
