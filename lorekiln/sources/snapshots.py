"""Versioned Parquet snapshots: a new version is written whole beside the old one, then named current in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return jvm, path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that were written completely, oldest first."""
    _, path, fs = _paths(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(path(f"{root}/{n}/_SUCCESS")))


def read(spark: SparkSession, root: str) -> DataFrame:
    """The current version: the last complete one. A run that died halfway leaves no current version behind."""
    return spark.read.parquet(f"{root}/v{versions(spark, root)[-1]}")


def write(df: DataFrame, root: str, partition_by: list[str] = (), keep: int = 2) -> int:
    """Writes the next version and drops all but the last ``keep``; never overwrites what a plan may still read."""
    spark = df.sparkSession
    done = versions(spark, root)
    new = (done[-1] if done else 0) + 1
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/v{new}")
    _, path, fs = _paths(spark, root)
    for old in (done + [new])[:-keep]:
        fs.delete(path(f"{root}/v{old}"), True)
    return new


#: Version of the tables' layout, stamped beside them.
LAYOUT = 2


def stamp(spark: SparkSession, root: str, version: int = LAYOUT) -> int:
    """Writes the layout's version where it isn't written yet, and returns the one that holds; a newer one than this code's is an error."""
    have = [r["version"] for r in read(spark, f"{root}/layout").collect()] if versions(spark, f"{root}/layout") else []
    if have and max(have) > version:
        raise RuntimeError(f"the tables are of layout {max(have)}, this code knows {version}")
    if version not in have:
        write(spark.createDataFrame([(version,)], "version int"), f"{root}/layout")
    return version


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with an id that follows from file_path and chunk_index, so that a run that is done again gives the same."""
    return chunks.withColumn("id", F.xxhash64(F.coalesce("file_path", F.lit("")), "chunk_index"))


def upserted_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks when files are written anew: those of the files in ``new`` go, its own come with their ids."""
    fresh = with_chunk_ids(new.drop("id")) if "id" in new.columns else with_chunk_ids(new)
    return old.join(new.select("file_path").distinct(), "file_path", "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def upserted_embeddings(old: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, embedding, model_version): new vectors replace those of the same chunk and model; one of another length than ``dim`` is an
    error, as it couldn't be compared."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("length "), F.size("embedding").cast("string"))).cast("array<float>")))
    keys = ["chunk_id", "model_version"]
    one = checked.dropDuplicates(keys)
    return old.join(one.select(*keys), keys, "left_anti").select(*old.columns).unionByName(one.select(*old.columns))


def without_files(df: DataFrame, files: DataFrame | None) -> DataFrame:
    """A table without the rows of some files; without a list, an empty table of the same columns."""
    return df.where("false") if files is None else df.join(files.select("file_path").distinct(), "file_path", "left_anti").select(*df.columns)


def write_all(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Next versions of several tables, in order; a table is current only when it is written whole, so a run that dies leaves the earlier
    ones new and the others as they were, and may be done again."""
    return {name: write(df, f"{root}/{name}") for name, df in tables.items()}
