"""What the corpus operators have in common: the shared folder, lineage cuts and safe column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: space and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"


#: A column that tells rows apart; no table has one of that name.
KEY = "_rankloom_row_key_"


#: Run folders that are to be deleted when the driver's JVM ends.
LEAVING: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine (tests) a
    temporary folder is made and set for the session; a cluster without it is an error, as its executors would write
    to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application's written tables are. The folder goes when the application ends, or before by ``clean``."""
    path = f"{shared_dir(spark)}/rankloom/{spark.sparkContext.applicationId}"
    if path not in LEAVING:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        LEAVING.add(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete this application's written tables, once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, tag: str, compression: str = "zstd", parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs one stage at most.

    Readers prune columns and push filters into the written table, and the next plan knows its size. ``parts`` bounds
    the number of files where rows are few and short.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.option("compression", compression).option("parquet.compression.codec.zstd.level", "1").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text is 2 modulo 4. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_share(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, for samples that come out alike on every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: the id and a hash of the text. Rows that agree in both are the same row repeated."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (one column, ``KEY``), a repeated row once, with all their columns.

    One shuffle by key serves the choice among repeated rows and the join. Tasks choose before it too (a window group
    limit), so that a row which is there very many times reaches no task as more than one row from each.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias(KEY))
    first = F.row_number().over(Window.partitionBy(KEY).orderBy(KEY))
    return keyed.withColumn("nth", first).where("nth = 1").drop("nth").join(kept.hint("merge"), KEY, "left_semi").select("row.*")
