"""Export of rendered scripts and configurations."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from urllib.parse import urlsplit

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What Spark writes as %XX in the folder names of a partitioned table, and the folder of null and empty names.
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_rendered(df: DataFrame, path: str, server: str = "server", script: str = "script", config: str = "config", tasks: int | None = None) -> None:
    """One folder per server, with its script and its configuration as text files.

    ``tasks`` is how many tasks create the files, by default as many as a shuffle has. Below a path of a
    mounted file system the tasks create them by themselves, in a folder that gets its name when all are
    there: Hadoop's local file system starts a process for every folder and file, to set its permissions.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.array(
        F.struct(F.lit("script").alias("kind"), F.col(script).alias("value")),
        F.struct(F.lit("config").alias("kind"), F.col(config).alias("value")),
    )
    rows = df.select(F.col(server).alias("server"), F.explode(parts).alias("p")).select("server", "p.*")
    rows = rows.filter(F.col("value").isNotNull()).repartition(tasks, "server")
    folder = _mounted(df.sparkSession, path)
    if folder is None or dict(rows.dtypes)["value"] != "string":
        rows.write.mode("overwrite").partitionBy("server", "kind").text(path)
        return
    written = f"{folder}-{uuid.uuid4().hex[:12]}"
    os.makedirs(written)
    name = F.nullif(F.col("server").cast("string"), F.lit("")).cast("binary").alias("server")
    try:
        rows.select(name, "kind", F.col("value").cast("binary")).sortWithinPartitions("server", "kind").foreachPartition(lambda part: _write_files(part, written))
    except BaseException:
        shutil.rmtree(written, ignore_errors=True)
        raise
    open(f"{written}/_SUCCESS", "w").close()
    if os.path.exists(folder):
        shutil.rmtree(folder)
    os.rename(written, folder)


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that a path names in a mounted file system; nothing for any other store."""
    parts = urlsplit(path)
    scheme = parts.scheme or urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")).scheme
    if scheme != "file" or parts.netloc or parts.query or parts.fragment:
        return None
    return os.path.abspath(parts.path).rstrip("/")


def _write_files(rows, folder: str) -> None:
    """One file for each server and kind of a task's sorted rows, laid out as Spark does."""
    task = TaskContext.get()
    file = out = last = None

    def close():
        if out is not None:
            out.close()
            # Another attempt of the task writes a file of its own and then gives it the same name.
            os.replace(out.name, file)

    for server, kind, value in rows:
        if last != (server, kind):
            close()
            last = server, kind
            name = _NO_NAME if server is None else _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", bytes(server).decode("utf-8", "replace"))
            at = f"{folder}/server={name}/kind={kind}"
            os.makedirs(at, exist_ok=True)
            file = f"{at}/part-{task.partitionId():05d}.txt"
            out = open(f"{at}/.part-{task.taskAttemptId()}", "wb")
        out.write(value)
        out.write(b"\n")
    close()


def read_rendered(spark: SparkSession, path: str) -> DataFrame:
    """Exported files back as ``server, kind, value``, one row per file.

    The names are taken from each file's path in the tasks. Spark's discovery of partitions would do so in
    the driver, in a time that grows with the square of their number, and read names like 007 as numbers.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    place = F.col("_metadata.file_path")
    server, kind = [F.regexp_extract(place, r"/server=([^/]*)/kind=([^/]*)/[^/]*$", i) for i in (1, 2)]
    # Once for the path as a URI, once for the folder's name.
    name = F.nullif(_decoded(_decoded(server)), F.lit(_NO_NAME))
    return files.select(name.alias("server"), kind.alias("kind"), F.regexp_replace("value", r"\n\z", "").alias("value"))


def _decoded(text):
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


_PACKED = "server string, kind string, value string, bucket int"


def _bucket(server, buckets: int):
    return F.pmod(F.xxhash64(server), F.lit(buckets)).cast("int")


def write_packed(df: DataFrame, path: str, server: str = "server", script: str = "script", config: str = "config", buckets: int = 256) -> None:
    """All scripts and configurations in ``buckets`` files, those of a server together and sorted by name.

    One file per bucket whatever the number of servers. A server's bucket follows from its name, and
    inside a file the names ascend, so reading one server opens one file and only the part that holds it.
    The number of buckets is stored beside the files. A null script or configuration has no row.
    """
    parts = F.array(
        F.struct(F.lit("script").alias("kind"), F.col(script).cast("string").alias("value")),
        F.struct(F.lit("config").alias("kind"), F.col(config).cast("string").alias("value")),
    )
    rows = df.select(F.col(server).cast("string").alias("server"), F.explode(parts).alias("p")).select("server", "p.*")
    rows = rows.filter(F.col("value").isNotNull()).withColumn("bucket", _bucket(F.col("server"), buckets))
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "server", "kind")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/files")
    df.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").json(f"{path}/layout")


def read_packed(spark: SparkSession, path: str, servers: list[str] | None = None) -> DataFrame:
    """``server, kind, value`` of a packed export, of all servers or of a few named ones.

    Named servers are looked up in their own buckets only, and in those by the ranges of names that
    the files keep.
    """
    rows = spark.read.schema(_PACKED).parquet(f"{path}/files")
    if servers is not None:
        buckets = spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"]
        names = spark.createDataFrame([(s,) for s in servers], "server string").select(_bucket(F.col("server"), buckets)).distinct()
        rows = rows.filter(F.col("bucket").isin([r[0] for r in names.collect()]) & F.col("server").isin(servers))
    return rows.drop("bucket")


def unpack(spark: SparkSession, path: str, servers: list[str], folder: str) -> None:
    """Folders and files of a few servers of a packed export, as ``write_rendered`` lays them out."""
    rows = read_packed(spark, path, servers)
    rows.repartition("server").write.mode("overwrite").partitionBy("server", "kind").text(folder)
