"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.functions.stored import shared_folder


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, which spark.checkpoint.dir names. Only a
    session of one process does without that setting; a cluster gets an error."""
    return shared_folder(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage like checkpoint() and survives lost executors, but keeps columns pruned
    and compressed.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


_PATHS: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        held, path = _PATHS.pop(id(table), (None, None))
        if held is table and path:
            delete_path(table.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path through Spark's file system layer, so that it works on any store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def words_array(text: Column) -> Column:
    """Words by the contracts' white space; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: white-space runs are squeezed to single blanks first."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    blanks = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", F.lit(0)).otherwise(blanks + 1).cast("long")
