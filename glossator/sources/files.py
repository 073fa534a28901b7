"""Files of a corpus: small ones from the driver, hashes of all of them, and folders of line files with fixed names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _at(spark, path)
    return system.exists(target)


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a folder is absent or has nothing in it."""
    system, target = _at(spark, path)
    return not system.exists(target) or not len(system.listStatus(target))


def delete(spark: SparkSession, path: str) -> None:
    system, target = _at(spark, path)
    system.delete(target, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, in UTF-8."""
    system, target = _at(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    _drop_checksum(spark, path)


def _drop_checksum(spark: SparkSession, path: str) -> None:
    folder, _, name = path.rpartition("/")
    system, hidden = _at(spark, f"{folder}/.{name}.crc")
    if system.exists(hidden):
        system.delete(hidden, False)


def get(spark: SparkSession, path: str) -> str:
    """Read a small text file; a missing one is an error that names it."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row.content).decode()


def get_object(spark: SparkSession, path: str) -> dict:
    """Read a JSON file, which must hold an object."""
    value = json.loads(get(spark, path))
    if not isinstance(value, dict):
        raise ValueError(f"expected a JSON object in {path.rpartition('/')[2]}")
    return value


def scanned(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path below the folder, sha256, bytes, crlf, ended) of the files of a folder and those below it; a file is hashed by one task."""
    system, target = _at(spark, folder)
    root = system.makeQualified(target).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+(?:[^/]*(?=//))?", "/")
    return files.select(
        F.substring(plain, F.lit(len(root) + 1), F.length(plain)).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"),
        F.contains(F.col("content"), F.lit(b"\r\n")).alias("crlf"), ((F.col("length") == 0) | F.endswith(F.col("content"), F.lit(b"\n"))).alias("ended"),
    )


def write_lines(values: DataFrame, folder: str, order: Column, key: Column, rows_per_file: int = 100_000) -> None:
    """Write ``values(group, value)`` as ``folder/<group>/part-00000.jsonl`` and so on; the bytes don't depend on the cluster.

    A row's file follows from a hash of ``key``, and rows are sorted by
    ``order`` within it; how many files a group has follows from its size.
    """
    spark = values.sparkSession
    sizes = {r.group: r["count"] for r in values.groupBy("group").count().collect()}
    files = {g: max(1, -(-n // rows_per_file)) for g, n in sizes.items()}
    count = F.lit(1)
    for g, n in files.items():
        count = F.when(F.col("group") == g, F.lit(n)).otherwise(count)
    placed = values.withColumns({"__o": order, "__f": F.pmod(F.xxhash64(key), count).cast("int")})
    parts = max(1, sum(files.values()))
    placed.repartition(parts, "group", "__f").sortWithinPartitions("group", "__f", "__o", "value").select("group", "__f", "value").write.partitionBy("group", "__f").option("compression", "none").mode("errorifexists").text(f"{folder}/_parts")
    system, root = _at(spark, folder)
    for g, n in files.items():
        _, home = _at(spark, f"{folder}/{g}")
        system.mkdirs(home)
        for k in range(n):
            _, own = _at(spark, f"{folder}/_parts/group={g}/__f={k}")
            if not system.exists(own):
                continue
            (made,) = [x.getPath() for x in system.listStatus(own) if x.getPath().getName().startswith("part-")]
            system.rename(made, _at(spark, f"{folder}/{g}/part-{k:05d}.jsonl")[1])
            _drop_checksum(spark, f"{folder}/{g}/part-{k:05d}.jsonl")
    delete(spark, f"{folder}/_parts")
