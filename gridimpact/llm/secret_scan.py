"""Secrets in text, with multipart credentials linked inside a scope.

Base kinds (assign, access, hex) stand alone. Weak kinds mean nothing alone: a 40-character key-like run
(linked_secret) is reported only if an access identifier starts within `scope` code points of it, an address
(linked_endpoint) only if both an access identifier and a secret do. The interval join of the parts is a range frame
over each document's spans in order, so no pair of spans is ever formed. Everything is DataFrame expressions: a
kind's matches and the pieces between them give the positions.

Defined results: null and empty texts have no spans; ties at one start are ordered by kind; repeated rows are
separate rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridimpact.llm.common import let, text_or_empty


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|"
    + either_case("api") + "_?" + either_case("key") + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: kind: (pattern, what a match must hold); in the order that breaks ties.
KINDS: dict[str, str] = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "linked_secret": r"[A-Za-z0-9/+]{40,}",  # '=', '_' and '-' end a key-like run, so that a name before it is no part of it
    "linked_endpoint": r"https?://[A-Za-z0-9.-]+",
}
BASE = ("assign", "access", "hex")


def _holds(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8
    if kind == "access":
        return F.length(match) >= 16
    if kind == "linked_secret":
        return (F.length(match) == 40) & match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    """array<struct<kind, at, gap, size, holds>>: gap is the length of what lies before the match since the last one."""
    pattern, order = KINDS[kind], list(KINDS).index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    row = lambda gaps: lambda m, i: F.struct(
        F.lit(order).alias("kind"), i.alias("at"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), _holds(kind, m).alias("holds")
    )
    rows = let(F.split(text, pattern, -1), lambda gaps: F.transform(found, row(gaps)))
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,holds:boolean>>"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """A row for each document: the identifier and found, its spans in order as array<struct<start, kind, end>> (kind: index in KINDS)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("row", "id", F.concat(*(_matches(k, F.col("text")) for k in KINDS)).alias("found"))
    rows = rows.select("row", "id", F.explode_outer("found").alias("m")).select("row", "id", "m.*").repartition("row")
    one = Window.partitionBy("row", "kind").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(one)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.withColumn("kind", F.when(F.col("holds"), F.col("kind")))  # a document keeps a row even if all its matches fail

    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    so_far = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    access, assign, weak, endpoint = (list(KINDS).index(k) for k in ("access", "assign", "linked_secret", "linked_endpoint"))
    count = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("int")).over(near), F.lit(0))
    inside = F.coalesce(F.max(F.when(F.col("kind") == assign, F.col("end"))).over(so_far) > F.col("start"), F.lit(False))
    rows = rows.select("row", "id", "kind", "start", "end", count(access).alias("n_access"), (count(assign) + count(weak)).alias("n_secret"), inside.alias("inside"))
    linked = (
        F.when(F.col("kind") == weak, (F.col("n_access") > 0) & ~F.col("inside"))
        .when(F.col("kind") == endpoint, (F.col("n_access") > 0) & (F.col("n_secret") > 0))
        .otherwise(F.col("kind").isNotNull())
    )
    span = F.when(linked, F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")))
    return rows.groupBy("row", "id").agg(F.array_sort(F.collect_list(span)).alias("found")).select(F.col("id").alias(id_col), "found")


def spans_text(found: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, scope: int = 400) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = secret_spans(docs, scope=scope)
    n = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    base = spans_text(F.filter("found", lambda s: s["kind"] < len(BASE)))
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))
