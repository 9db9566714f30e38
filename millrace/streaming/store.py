"""The registry as a table that streams update, and a sink that sends from the tasks.

Each micro-batch is merged per handle and written beside the earlier ones; a manifest of one small file then makes it part
of the table.  A manifest says which folders the table consists of and which batch came last: a batch that is tried again
after a failure finds its number and is done, one that was not yet in a manifest is written again in the same place.
After some batches all folders are merged into one, under the same switch.  Readers name a version, or take the last; what
they read stays until ``vacuum`` removes folders that no kept version names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from millrace.operators.registry import POSTS, REASONS, band_rank

_MANIFEST = "folder string, place int, batch long, version int"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class RegistryStore:
    """Accounts by handle under ``path``, in any store that Spark writes to; one stream writes, any number of jobs read."""

    def __init__(self, spark: SparkSession, path: str, most: int = 8):
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def versions(self) -> list[int]:
        files, p = _path(self.spark, f"{self.path}/manifest")
        if not files.exists(p):
            return []
        # A version counts once its file is there, which is the last thing that its job does.
        return sorted(int(x.getPath().getName().partition("=")[2]) for x in files.listStatus(p) if any(f.getPath().getName().startswith("part-") for f in files.listStatus(x.getPath())))

    def manifest(self, version: int | None = None) -> tuple[int, int, list[str]]:
        """Version, last batch and folders in the order of their making; (0, -1, []) before the first batch."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return 0, -1, []
        rows = self.spark.read.schema(_MANIFEST.rpartition(",")[0]).parquet(f"{self.path}/manifest/version={version}").orderBy("place").collect()
        return version, rows[0]["batch"], [r["folder"] for r in rows]

    def _switch(self, version: int, batch: int, folders: list[str]) -> None:
        rows = [(f, i, batch) for i, f in enumerate(folders)]
        self.spark.createDataFrame(rows, _MANIFEST.rpartition(",")[0]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _merged(self, folders: list[str]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{f}").withColumn("place", F.lit(i)) for i, f in enumerate(folders)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        # At most as many lists of bounded length as there are folders come together for a handle.
        line = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c])))
        last = lambda c, n: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n)
        out = rows.groupBy("handle").agg(
            F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("best_band", band_rank(F.col("best_band"))).alias("best_band"),
            line("reasons").alias("reasons"), line("post_ids").alias("post_ids"),
        )
        return out.withColumn("reasons", F.slice("reasons", 1, REASONS)).withColumn("post_ids", last("post_ids", POSTS))

    def upsert(self, sightings: DataFrame, number: int) -> None:
        """Merges the sightings (handle, ts, band, and reasons and id if there are any) of micro-batch ``number``, once."""
        version, batch, folders = self.manifest()
        if number <= batch:
            return
        have = set(sightings.columns)
        rows = sightings.withColumn("reasons", F.col("reasons") if "reasons" in have else F.array().cast("array<string>")).withColumn("post", (F.col("id") if "id" in have else F.lit(None)).cast("string"))
        listed = rows.groupBy("handle").agg(
            F.count("*").alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("band", band_rank(F.col("band"))).alias("best_band")
        )
        reasons = _few(rows.select("handle", "ts", F.posexplode("reasons").alias("n", "value")), REASONS, False)
        posts = _few(rows.where("post is not null").select("handle", "ts", F.lit(0).alias("n"), F.col("post").alias("value")), POSTS, True)
        empty = F.array().cast("array<string>")
        delta = listed.join(reasons.withColumnRenamed("few", "reasons"), "handle", "left").join(posts.withColumnRenamed("few", "post_ids"), "handle", "left")
        folder = f"batch={number}"
        delta.select("handle", "hits", "first_seen", "last_seen", "best_band", F.coalesce("reasons", empty).alias("reasons"), F.coalesce("post_ids", empty).alias("post_ids")).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        folders = [*folders, folder]
        if len(folders) > self.most:
            self._merged(folders).write.mode("overwrite").parquet(f"{self.path}/merged={number}")
            folders = [f"merged={number}"]
        self._switch(version + 1, number, folders)

    def read(self, version: int | None = None) -> DataFrame:
        """handle, hits, first_seen, last_seen, best_band, reasons, post_ids as of a version."""
        folders = self.manifest(version)[2]
        if not folders:
            return self.spark.createDataFrame([], "handle string, hits long, first_seen timestamp, last_seen timestamp, best_band string, reasons array<string>, post_ids array<string>")
        return self._merged(folders)

    def vacuum(self, keep: int = 10) -> list[str]:
        """Removes old versions and the folders that only they name; returns what went."""
        known = self.versions()
        kept = {f for v in known[-keep:] for f in self.manifest(v)[2]}
        gone = sorted({f for v in known[:-keep] for f in self.manifest(v)[2]} - kept)
        for f in [*gone, *(f"manifest/version={v}" for v in known[:-keep])]:
            files, p = _path(self.spark, f"{self.path}/{f}")
            files.delete(p, True)
        return gone

    def write_stream(self, decided: DataFrame, checkpoint: str):
        """Blocked accounts of a stream of decisions."""
        return decided.writeStream.foreachBatch(lambda batch, number: self.upsert(batch.where("band = 'block'"), number)).option("checkpointLocation", checkpoint)


def _few(rows: DataFrame, most: int, latest: bool) -> DataFrame:
    """handle and the first (or last) ``most`` distinct values of it, in order of first sight."""
    first = rows.groupBy("handle", "value").agg(F.min(F.struct("ts", "n")).alias("at"))
    ahead = (F.desc("at"), F.desc("value")) if latest else (F.asc("at"), F.asc("value"))
    kept = first.withColumn("rank", F.row_number().over(Window.partitionBy("handle").orderBy(*ahead))).where(F.col("rank") <= most)
    return kept.groupBy("handle").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("few"))


class _Sent(WriterCommitMessage):
    def __init__(self, sent: int, failed: int):
        self.sent, self.failed = sent, failed


class _Notifier(DataSourceWriter, DataSourceStreamWriter):
    """Sends each row of a partition, as JSON, where the partition is; only two numbers a task reach the driver."""

    def __init__(self, notify: Callable[[str], None], done: Callable[[int, int, int | None], None] | None):
        self.notify, self.done = notify, done

    def write(self, iterator) -> _Sent:
        sent = failed = 0
        for row in iterator:
            try:
                self.notify(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
                sent += 1
            except Exception:  # noqa: BLE001  a receiver that fails must not stop the stream
                failed += 1
        return _Sent(sent, failed)

    def commit(self, messages, batchId: int | None = None) -> None:  # noqa: N803
        if self.done is not None:
            self.done(sum(m.sent for m in messages if m), sum(m.failed for m in messages if m), batchId)

    def abort(self, messages, batchId: int | None = None) -> None:  # noqa: N803
        pass


def notifier(name: str, notify: Callable[[str], None], done: Callable[[int, int, int | None], None] | None = None) -> type[DataSource]:
    """A format to register (``spark.dataSource.register``) and write to, by batch or by stream: ``notify`` gets each row.

    ``done`` hears how many rows were sent and failed.  A task that is run again sends its rows again, so receivers must
    know rows by their number.
    """

    class Notifications(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite):
            return _Notifier(notify, done)

        def streamWriter(self, schema, overwrite):  # noqa: N802
            return _Notifier(notify, done)

    return Notifications
