"""Sources as a stream: manifests that arrive are parsed, and the newest of each file is kept.

A file source's micro-batches are parsed by the same plan as a batch. The state is
a table of the newest content of each (repo, path); a file whose git id has not
changed is not parsed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import git_blob_sha


def newest(rows: DataFrame) -> DataFrame:
    """The newest of each (repo, path) by seq; of equal ones the greater git id."""
    rest = [c for c in rows.columns if c not in ("repo", "path")]
    return rows.groupBy("repo", "path").agg(F.max_by(F.struct(*rest), F.struct("seq", "blob")).alias("r")).select("repo", "path", "r.*")


def changed(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """What of arrived (repo, path, blob, seq, ...) is newer than known and differs from it."""
    seen = known.select("repo", "path", F.col("blob").alias("old_blob"), F.col("seq").alias("old_seq"))
    both = newest(arrived).join(seen, ["repo", "path"], "left")
    return both.where("old_seq is null or (seq > old_seq and blob <> old_blob)").drop("old_blob", "old_seq")


#: The state is dealt into so many folders by repository and path; a micro-batch rewrites those that it touches.
STATE_PARTS = 64


def start_upserts(spark: SparkSession, folder: str, state: str, checkpoint: str, parts: int = STATE_PARTS) -> StreamingQuery:
    """Follow a folder of JSON lines (repo, path, content, seq) into a state table; runs until what is there is read.

    The state is a log of versions by part: state/part=<k>/v=<epoch>. A micro-batch reads the newest version of the
    parts that its rows fall into, writes their next one, and drops what is older than the one before. A repeated epoch
    starts from the versions before it and writes the same again."""
    stream = spark.readStream.schema("repo string, path string, content string, seq long").json(folder)
    stream = stream.withColumn("blob", git_blob_sha(F.col("content").cast("binary"))).withColumn("part", F.pmod(F.xxhash64("repo", "path"), F.lit(parts)).cast("int"))

    def merge(batch: DataFrame, epoch: int) -> None:
        session, columns = batch.sparkSession, [c for c in batch.columns if c != "part"]
        batch.persist()
        touched = [r[0] for r in batch.select("part").distinct().collect()]  # at most `parts`
        found = versions(session, state)
        before = {k: max((v for v in found.get(k, []) if v < epoch), default=None) for k in touched}
        paths = [f"{state}/part={k}/v={v}" for k, v in before.items() if v is not None]
        known = session.read.parquet(*paths).select(columns) if paths else batch.select(columns).limit(0)
        fresh = changed(batch.select(columns), known)
        kept = known.join(fresh.select("repo", "path"), ["repo", "path"], "left_anti")
        out = kept.unionByName(fresh).withColumn("part", F.pmod(F.xxhash64("repo", "path"), F.lit(parts)).cast("int")).withColumn("v", F.lit(epoch))
        out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "v").parquet(state)
        for k in touched:
            for v in found.get(k, []):
                if before[k] is not None and v < before[k]:
                    _delete(session, f"{state}/part={k}/v={v}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, state: str) -> dict[int, list[int]]:
    """The versions that each part of a state has, by the folders' names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/part=*/v=*")
    found: dict[int, list[int]] = {}
    for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
        name = status.getPath()
        found.setdefault(int(name.getParent().getName().split("=")[1]), []).append(int(name.getName().split("=")[1]))
    return found


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def state_table(spark: SparkSession, state: str) -> DataFrame:
    """The newest version of every part: what the stream has kept so far."""
    paths = [f"{state}/part={k}/v={max(vs)}" for k, vs in versions(spark, state).items()]
    return spark.read.parquet(*paths)
