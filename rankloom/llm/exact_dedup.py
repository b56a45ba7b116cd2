"""Exact deduplication against a persistent digest index.

The index is a Parquet table with one row per distinct digest, bucketed and sorted by digest. A new batch is first
reduced to one row per digest (combined before the shuffle, so a text that fills a third of the batch is one row per
task), then a sort-merge anti-join with the index tells the new digests, which are appended under the batch's name.
What stays is read from the index after that. Bucketing means that the index itself is never shuffled for those joins,
however large it has grown; the number of buckets comes from the rows of the first batch.

A batch that is given again under its name, after a run that failed at whatever point, has the same result: digests
that it brought itself are its own, and only those that the index lacks are appended.

Defined results: a null text counts as the empty text; a text of any length is hashed whole; rows that repeat an id are
separate rows; a null id loses ties against any other id; further columns are ignored. An empty batch gives no rows and
leaves the index as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.shared import KEY, WHITE, cut, keep_rows, row_key, run_dir


#: Digests to a bucket, some 100 MB, and the buckets of a small index.
PER_BUCKET, LEAST_BUCKETS = 1_000_000, 16


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without ASCII white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", "").cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, kept under ``path``. A later session that gives the same path goes on with it.

    ``buckets`` is that of a new index; without it there is one for each ``PER_BUCKET`` digests of the first batch. The
    folder's name keeps the number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        self.folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in self.files.listStatus(self.folder)] if self.files.exists(self.folder) else []
        known = [int(name.removeprefix("buckets-")) for name in found if name.startswith("buckets-")]
        if known:
            self.buckets = known[0]
        if self.buckets:
            self._create()

    def _create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, n_chars BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/buckets-{self.buckets}'"
        )

    def sized_for(self, digests: int) -> None:
        """Make the table, where there is none yet, for a first batch of so many digests."""
        if not self.buckets:
            most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
            self.buckets = min(max(LEAST_BUCKETS, -(-digests // PER_BUCKET)), most)
            self._create()

    def read(self) -> DataFrame:
        """The index as a bucketed table: joins on digest need no shuffle of it."""
        return self.spark.table(self.name)

    def append(self, heads: DataFrame, batch: str) -> None:
        """Add the rows of ``heads`` (digest, keep_id, n_chars) whose digest the index lacks, under the batch's name."""
        fresh = heads.select("digest", "keep_id", "n_chars").join(self.read().hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Forget the index and delete its files. Results that were given stay readable."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.files.delete(self.folder, True)


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest id. Where the index already knew the
    text, the row that brought it there stays and all of the batch go. group_size counts rows of this batch. A batch
    without a name gets one that no other has.
    """
    return _judged(docs, index, id_col, text_col, batch).drop(KEY)


def _judged(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, batch: str | None = None) -> DataFrame:
    text, batch = F.col(f"`{text_col}`"), batch or uuid.uuid4().hex
    rows = cut(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            digest(text).alias("digest"),
            F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
            row_key(F.col(f"`{id_col}`"), text).alias(KEY),
        ),
        "digests",
    )
    best = F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    heads = cut(
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.neg")).alias("n_chars"), F.col("best.row").alias("keep_row"), "group_size"),
        "heads",
    )
    index.sized_for(heads.count())
    index.append(heads, batch)
    own = (F.col("batch") == batch).alias("own")  # what the anti-join let in, at this attempt or one before it
    found = cut(heads.select("digest", "keep_row", "group_size").join(index.read().select("digest", "keep_id", own).hint("merge"), "digest"), "known")
    # Both sides are plain tables here, so that the join shuffles both and adaptive execution can split a hot digest.
    return rows.join(found, "digest").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("own") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        KEY,
    )


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An index of its own, in the shared folder, for one run."""
    return DigestIndex(spark, f"{run_dir(spark)}/digest-index-{uuid.uuid4().hex}")


def keep_first(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, _judged(docs, index, id_col, text_col).where("kept").select(KEY), id_col, text_col)
