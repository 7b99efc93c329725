"""What the training-data operators share: words, scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions.folders import remove, shared_dir

_WRITE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
# The white space of the contracts, as a character list and as a regex class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """Bind `value` to a lambda variable, so that it is computed once however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the maximal runs of other than white space; null or blank text: empty."""
    none = F.array().cast("array<string>")
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", none).otherwise(F.split(t, SPACE_CLASS + "+")),
    )


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased, every other character kept (lower() alone also maps other letters)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(s) == F.octet_length(s), F.lower(s)).otherwise(F.translate(s, upper, upper.lower()))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    remove(spark, path, at_exit=True)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder once and read it back. The shuffle files of the
    write go when it ends, as nothing reads them again, and Python is handed smaller batches than the session
    has; both settings hold for this write alone and are put back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {key: spark.conf.get(key) for key in _WRITE}
    try:
        for key, value in _WRITE.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a materialised table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, path)
