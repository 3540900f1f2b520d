"""Reading and writing of stage tables, and tables that cut a plan in two."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, paths: str | list[str], schema: StructType | str, pattern: str | None = None) -> DataFrame:
    """CSV files with a header and a given schema; one glob reads what used to be a file for each country."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(paths)


def with_nulls(df: DataFrame) -> DataFrame:
    """NaN and empty strings as NULL, the only mark of a missing value."""
    fixed: dict[str, Column] = {}
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            fixed[field.name] = F.when(~F.isnan(column), column)
        elif isinstance(field.dataType, StringType):
            fixed[field.name] = F.when(column != "", column)
    return df.withColumns(fixed)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_stage(df: DataFrame, path: str, by: Sequence[str] = (), append: bool = False) -> None:
    """A stage's table; with `by`, only the partitions that df holds are replaced."""
    writer = df.write.mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """Comma-separated files with a header, a file for each task; missing values are empty."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def not_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose keys are not among those done: resuming a stage."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def split_known(keys: DataFrame, archive: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The archive's rows of the keys, and the keys that it lacks, which are reported and do not stop a run."""
    return archive.join(keys.select(key).distinct(), key, "left_semi"), keys.join(archive.select(key).distinct(), key, "left_anti")


def country_list(units: DataFrame, column: str, configured: Sequence[str] | None = None) -> DataFrame:
    """The configured countries, or else all that occur, in order."""
    if configured:
        return units.sparkSession.createDataFrame([(c,) for c in configured], f"{column} string")
    return units.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def clear_settled(spark: SparkSession) -> None:
    """Deletes the tables that `settled` wrote for this application; call it when no result is in use."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{where}/stages/{context.applicationId}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the folder that all executors share and reads it back, so that later plans start there."""
    spark = df.sparkSession
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="gridimpact-")
        context.setCheckpointDir(where)
    path = f"{where}/stages/{context.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
