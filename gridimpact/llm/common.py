"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(spark_id: Column, folds: int) -> Column:
    """crc32 of the identifier written as text, modulo the number of folds (null: the empty string)."""
    return F.crc32(F.encode(F.coalesce(spark_id.cast("string"), F.lit("")), "UTF-8")) % folds


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(columns: Sequence[str], *stems: str) -> list[str]:
    """A name for each stem that no column has, upper and lower case being the same."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of these names (upper and lower case being the same) under others, and what gives them back."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    others = unused(df.columns, *(f"_kept_{c}" for c in clash))
    return df.withColumnsRenamed(dict(zip(clash, others, strict=True))), dict(zip(others, clash, strict=True))


def bounded_sample(rows: DataFrame, id_col: str, max_rows: int, once: bool = False) -> DataFrame:
    """At most max_rows rows, chosen by a hash of the identifier; all where there are no more. once: equal rows count as one."""
    share = min(1.0, 1.2 * max_rows / max(1, rows.count()))  # so that tasks send about as much as is kept
    place = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 40))
    chosen = rows.where(place < int(share * (1 << 40)))
    return (chosen.distinct() if once else chosen).orderBy(place, id_col).limit(max_rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none, as in tests."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="gridimpact-")
        context.setCheckpointDir(where)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, when what depends on them is written too."""
    for df in tables:
        context, files = df.sparkSession.sparkContext, df.inputFiles()
        if files:
            path = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clear_work(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote with `written`; call it when no result is in use."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/work/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files behind tables that are written.

    Spark does so for plans that the driver has forgotten, when it collects its garbage; the second turn gets what
    the first has only marked.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
