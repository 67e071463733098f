"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text.  A batch
of documents is reduced to one row for each digest, anti-joined with the index
bucket by bucket (a sort-merge join that does not shuffle the index), and the
digests that are new are appended.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hadoop_path, text_digest, without_rows

#: A digest with at least 1/HOT_SHARE of a batch's rows is joined by broadcast: there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Digests that a bucket of a new index is laid out for (some 100 MB), and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 16


class DigestIndex:
    """A bucketed, sorted table ``digest binary, keep_id`` at ``path``.

    ``path`` must be in a store that every executor reaches.  ``buckets`` is
    fixed at creation and read from ``_meta`` when a later session opens the
    index by its path: :func:`buckets_for` gives it for the number of digests
    that the index will hold.  Every append adds a file to each bucket;
    :meth:`compacted` writes them as one.

    One writer at a time: of two appends that run at once each may add the same
    digest.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        meta, fs = hadoop_path(spark, f"{self.path}/_meta")
        if fs.exists(meta):
            buckets = json.loads(spark.read.text(f"{self.path}/_meta/part-*").first()[0])["buckets"]
        else:
            spark.createDataFrame([(json.dumps({"buckets": buckets}),)], "value string").coalesce(1).write.text(f"{self.path}/_meta")
        self.buckets = buckets
        data, _ = hadoop_path(spark, f"{self.path}/data")
        fs.mkdirs(data)
        self.is_empty = not any(f.getPath().getName().startswith("part-") for f in fs.listStatus(data))
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/data'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def lacking(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups(digest, ...)`` whose digest the index does not hold."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame) -> None:
        """Add ``new(digest, keep_id)``, which the index must lack."""
        new.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.is_empty = False

    def compacted(self, path: str, buckets: int | None = None) -> DigestIndex:
        """The same index at another path, one sorted file a bucket; ``buckets`` may change its number of buckets."""
        other = DigestIndex(self.spark, path, buckets or self.buckets)
        other.append(self.read())
        return other

    def close(self) -> None:
        """Forget the table's name in this session; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def buckets_for(count: int) -> int:
    """Buckets of an index of so many digests."""
    return max(LEAST_BUCKETS, math.ceil(count / BUCKET_ROWS))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch against ``index`` and add its new digests to it.

    Of the batch's equal texts the row with the largest id stays, unless the
    index held that digest before: then ``keep_id`` is the earlier id, and no
    row of the batch stays, not even one with that same id.  Rows that repeat
    both id and text share their fate: each of them carries ``kept``.

    Null texts count as empty; a null id ranks below every id and stays only in
    a group without any other (later batches see it as held, with a null
    ``keep_id``).  ``group_size`` counts the batch's own rows.  An empty batch
    gives an empty result and leaves the index alone.  Columns besides the two
    named are neither read nor kept.

    Returns ``doc_id long, keep_id long, group_size long, kept boolean,
    text_sha256 string`` with one row for each row of the batch.
    """
    with Scratch(docs.sparkSession, "exact") as scratch:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"))
        rows, total = scratch.counted(rows, "digests")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        if not index.is_empty:
            groups = scratch.write(groups, "groups")
        new = scratch.write(index.lacking(groups).withColumn("new", F.lit(True)), "new")
        chosen = new
        if not index.is_empty:
            held = groups.select("digest", "group_size").join(index.read().hint("merge"), "digest")
            chosen = scratch.write(new.unionByName(held.withColumn("new", F.lit(False))), "chosen")
        if total:
            index.append(new)
        hot = F.col("group_size") * HOT_SHARE >= F.lit(max(total, HOT_SHARE * 2))  # holds for at most HOT_SHARE digests
        named = lambda df, p: df.select("digest", *[F.col(c).alias(p + c) for c in ("keep_id", "group_size", "new")])
        flagged = rows.join(F.broadcast(named(chosen.where(hot), "hot_")), "digest", "left")
        of_hot = flagged.where("hot_new is not null").select("doc_id", "digest", *[F.col(f"hot_{c}").alias(c) for c in ("keep_id", "group_size", "new")])
        rest = flagged.where("hot_new is null").select("doc_id", "digest").join(chosen.where(~hot), "digest").select("doc_id", "digest", "keep_id", "group_size", "new")
        kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        out = of_hot.union(rest).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
        return scratch.write(out, "result", keep=True)


def dedup_once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`exact_dedup` against a new index, which is laid out by the number of rows and goes afterwards."""
    spark = docs.sparkSession
    with Scratch(spark, "exact-once") as scratch:
        index = DigestIndex(spark, scratch.own_path("index"), buckets_for(docs.count()))
        out = exact_dedup(docs, index, id_col, text_col)
        index.close()
    return out


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of equal texts the row with the largest id; of rows that repeat id and text, one; all columns, nothing else.

    Rows go by id and text, so a row that merely shares its id with a copy
    stays.  A null id ranks below every id.  Null texts count as empty.
    """
    with Scratch(docs.sparkSession, "copies") as scratch:
        found = dedup_once(docs, id_col, text_col).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"), "kept")
        gone = scratch.write(found.where("not kept").select("id", "digest").distinct(), "gone", keep=True)
        again = scratch.write(found.where("kept").groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("id", "digest"), "again", keep=True)
        return without_rows(docs, gone, again, id_col, text_col)
