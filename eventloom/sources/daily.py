"""Folders of daily files: the day stands in the path, so days outside a range are never opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column of lines that do not fit the schema.
BAD = "_bad"


def _schema(fields: str, *more: T.StructField) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(fields).fields, *more, T.StructField(BAD, T.StringType())])


def _read(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def day_folders(spark: SparkSession, path: str, low: str, high: str, fields: str, day: str = "dt") -> DataFrame:
    """JSON lines of folders <day>=YYYY-MM-DD from `low` to `high`: the fields, the day and `_bad`, the text of lines that don't parse (else null).

    The range is a filter on the partition column, so Spark lists and opens only the folders inside it.
    """
    return _read(spark, _schema(fields, T.StructField(day, T.StringType())), path).where(F.col(day).between(low, high))


def day_files(spark: SparkSession, path: str, low: str, high: str, fields: str, day: str = "day") -> DataFrame:
    """JSON lines of files named YYYY-MM-DD<anything>, with their day from the name; files of other days are left out before any is opened."""
    name = F.substring(F.col("_metadata.file_name"), 1, 10)
    rows = _read(spark, _schema(fields), path).where(F.col("_metadata.file_name").between(low, high + "~"))
    return rows.select("*", name.alias(day))


def audited(rows: DataFrame, by: list[str], *good: object) -> DataFrame:
    """Per file, day or other columns: lines in all, bad ones, and aggregates `good` over the rows, which are null in bad lines."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count(BAD).alias("bad"), *good)


def write_day_files(df: DataFrame, path: str, day: str, kind: str = "json", suffix: str = ".jsonl") -> None:
    """A folder of files YYYY-MM-DD-<number><suffix>: a day may have several. They are written by day and then moved to their names."""
    df.write.partitionBy(day).format(kind).save(f"{path}.tmp")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    root, target = hadoop.Path(f"{path}.tmp"), hadoop.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(target)
    for folder in store.listStatus(root):
        if folder.isDirectory():
            date = folder.getPath().getName().partition("=")[2]
            for i, file in enumerate(store.listStatus(folder.getPath())):
                store.rename(file.getPath(), hadoop.Path(target, f"{date}-{i}{suffix}"))
    store.delete(root, True)
