"""The stored feedback table: unique by ``predict_id``, versioned, safe against replayed batches.

    data/version=N/bucket=K     rows of bucket K as version N left them
    manifest/version=N          one row per bucket: the version its rows lie in; and the batch behind N
    rejects/version=N           rows that the batch of version N could not insert, with their reasons

An insert writes only the buckets it touches (all their rows anew) and then the manifest; readers follow the
newest whole manifest, so they see a batch entirely or not at all.  A batch that is known already changes
nothing.  One writer at a time; the manifest has as many rows as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_path
from .feedback import FEEDBACK_COLUMNS, upsert

BUCKETS = 64
SCHEMA = "id int, predict_id string, message string, reported_anomaly_status boolean, created_date timestamp, customer_id string"


class FeedbackStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _versions(self) -> list[int]:
        """Published versions: those whose manifest was written to its end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/version=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _manifest(self, version: int) -> dict[int, int]:
        return {r["bucket"]: r["holds"] for r in self.spark.read.parquet(f"{self.root}/manifest/version={version}").collect()
                if r["bucket"] is not None}

    def version(self) -> int:
        """The newest published version; 0 before the first insert."""
        return max(self._versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the newest version or of an earlier one."""
        version = self.version() if version is None else version
        held = self._manifest(version) if version else {}
        paths = [f"{self.root}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths).select(*FEEDBACK_COLUMNS)

    def rejects(self) -> DataFrame:
        """Rows that could not be inserted, with ``reject_reason`` and the version of their batch."""
        done = self._versions()
        return self.spark.read.option("basePath", f"{self.root}/rejects") \
            .parquet(*[f"{self.root}/rejects/version={v}" for v in done]).withColumn("version", F.col("version").cast("int"))

    def insert(self, validated: DataFrame, batch_id: str) -> int:
        """Insert ``feedback.validate`` rows; the version that holds them (the old one for a known batch).

        Ids that are stored already, or come earlier in the batch, are rejected; numbers continue.
        """
        done = self._versions()
        if done:
            known = self.spark.read.option("basePath", f"{self.root}/manifest").parquet(
                *[f"{self.root}/manifest/version={v}" for v in done]).where(F.col("batch") == batch_id).select("version").first()
            if known:
                return int(known["version"])
        version = (done[-1] if done else 0) + 1
        for part in ("data", "manifest", "rejects"):        # left by an insert that did not end
            drop_path(self.spark, f"{self.root}/{part}/version={version}")
        held = self._manifest(done[-1]) if done else {}
        fresh, rejected = upsert(self.read(), cut_lineage(validated))
        bucket = F.pmod(F.xxhash64("predict_id"), F.lit(self.buckets)).cast("int")
        fresh = cut_lineage(fresh.withColumn("bucket", bucket))
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
        rows = fresh
        old = [f"{self.root}/data/version={held[b]}/bucket={b}" for b in sorted(touched & held.keys())]
        if old:
            rows = rows.unionByName(self.spark.read.schema(SCHEMA).parquet(*old).withColumn("bucket", bucket))
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/data/version={version}")
        rejected.write.mode("overwrite").parquet(f"{self.root}/rejects/version={version}")
        held |= dict.fromkeys(touched, version)
        told = [(b, v, batch_id) for b, v in sorted(held.items())] or [(None, None, batch_id)]
        self.spark.createDataFrame(told, "bucket int, holds int, batch string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        return version
