"""Exact duplicates by sorting content.

Spark samples splitters, deals rows into ranges of the normalised text (of its beginning and, where beginnings are equal,
a hash), sorts each range (spilling to disk) and compares neighbours in full, so equal texts end up side by side in one range. A text
with more rows than a quarter of an average range would fill ranges of its own: such texts are found in a sample that grows with the
number of ranges, their rows get a salt in the sort key, as many salts as they fill quarters of a range, and one small pre-aggregated row
for each hot text joins the shares again. Which texts are salted affects only the spread of the work, never the result.

Defined results: null text counts as empty; empty texts form a group like any other; repeated rows with one
identifier count as separate rows and exactly one of them is kept; null identifiers lose against any other; an
empty table gives an empty table; other columns of any name pass through, except that a column named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from gridimpact.llm.common import checkpointed, text_or_empty, unused

OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(column: str, how: str) -> Column:
    """`none`: as it is. `loose`: lower case, runs of white space as one space, trimmed."""
    text = text_or_empty(column)
    if how == "none":
        return text
    if how == "loose":
        return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    raise ValueError(f"unknown normalisation: {how}")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: str = "none",
    keep: str = "smallest",
    hot_share: float | None = None,
    sample_rows: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """All rows of `docs` with keep_id, group_size, kept and text_sha256 of the normalised text.

    hot_share (of all rows; else a quarter of a range's share), sample_rows (else 64 for each such share) and salts (else by the text's rows)
    only say which texts are spread over how many ranges.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"unknown keep: {keep}")
    share = hot_share or 1 / (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sampled = sample_rows or max(20_000, int(64 / share))
    docs = docs.drop(*OUTPUTS)
    key, start, code, salt, n_salts, rank, own, whole_id, whole_salt, size = unused(
        [*docs.columns, *OUTPUTS], *(f"_{x}" for x in ("key", "start", "code", "salt", "salts", "rank", "own", "id", "from", "size"))
    )
    keyed = docs.withColumn(key, normalised(text_col, normalise)).withColumn(code, F.xxhash64(key))

    fraction = min(1.0, sampled / max(1, docs.count()))
    least = max(4, int(share * sampled))
    hot = keyed.select(code).sample(fraction, seed=7).groupBy(code).count().where(F.col("count") >= least)
    hot = checkpointed(hot.select(code, (F.lit(salts) if salts else F.ceil(F.col("count") / least)).cast("int").alias(n_salts)))  # at most 1 / share rows

    others = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType) and f.name != text_col]  # what tells a hot text's rows apart
    place = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0), F.col(n_salts)).cast("int")
    salted = keyed.join(F.broadcast(hot), code, "left").withColumn(salt, F.coalesce(place, F.lit(0))).withColumn(start, F.substring(key, 1, 32))
    dealt = salted.repartitionByRange(start, code, salt)  # splitters are short, since their sample goes to the driver
    best_first = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    group = Window.partitionBy(start, code, salt, key)
    ranked = dealt.select(
        *docs.columns,
        F.when(F.col(n_salts).isNotNull(), F.col(salt)).alias(own),
        F.row_number().over(group.orderBy(best_first)).alias(rank),
        F.first(id_col).over(group.orderBy(best_first)).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        F.sha2(key, 256).alias("text_sha256"),
    )
    if hot.isEmpty():
        kept = F.col(rank) == 1
        return ranked.select(*docs.columns, "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    known = F.col(id_col).isNotNull()
    best = F.max(F.struct(known, id_col, (-F.col(salt)).alias("at"))) if keep == "largest" else F.min(F.struct(~known, id_col, F.col(salt).alias("at")))
    whole = salted.where(F.col(n_salts).isNotNull()).groupBy(key).agg(best.alias("best"), F.count(F.lit(1)).alias(size))
    (text_hash,) = unused([*ranked.columns, whole_id, whole_salt, size], "_sha")
    whole = whole.select(F.sha2(key, 256).alias(text_hash), F.col("best")[id_col].alias(whole_id), F.abs("best.at").alias(whole_salt), size)
    both = ranked.join(F.broadcast(whole), (F.col(own).isNotNull()) & (F.col("text_sha256") == F.col(text_hash)), "left")  # a row for each hot text
    spread = F.col(own).isNotNull()
    keep_id = F.when(spread, F.col(whole_id)).otherwise(F.col("keep_id"))
    kept = (F.col(rank) == 1) & (~spread | (F.col(id_col).eqNullSafe(F.col(whole_id)) & (F.col(own) == F.col(whole_salt))))
    return both.select(*docs.columns, keep_id.alias("keep_id"), F.coalesce(size, "group_size").alias("group_size"), kept.alias("kept"), "text_sha256")
