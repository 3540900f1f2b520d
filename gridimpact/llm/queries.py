"""The registered queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridimpact.llm.bpe import bpe_digest
from gridimpact.llm.common import table
from gridimpact.llm.conversation_repair import damaged, repaired
from gridimpact.llm.exact_dedup import exact_dedup
from gridimpact.llm.fingerprints import with_successors
from gridimpact.llm.html_extract import main_text
from gridimpact.llm.jaccard_join import near_duplicates
from gridimpact.llm.mixing import mixing_rates
from gridimpact.llm.periodic_runs import planted, runs_digest
from gridimpact.llm.quality_classifier import quality_scores
from gridimpact.llm.quality_rules import CLASSES, COMMON_WORDS, N_WORDS, quality_rules
from gridimpact.llm.secret_scan import KINDS, secret_digest
from gridimpact.llm.suffix_dedup import repeated_digest
from gridimpact.llm.toxicity import toxicity

#: The public vocabulary of the BPE query; installed with the tokenizer files, never part of this repository.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_digest(table(spark, sf_dir, "documents"), length=200)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = WORD_BPE) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), vocabulary)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior over the domains is given in thousandths."""
    rated = mixing_rates(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), again=False)
    thousandths = F.transform("domains", lambda p: F.round(1000 * p).cast("int"))
    return rated.select("doc_id", "n_tokens", thousandths.alias("domains"), F.round("rate", 4).alias("rate"), "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successors(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")), present_col="present")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(table(spark, sf_dir, "documents"), edit=planted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_html_extract": op10_html_extract,
    "op11_fingerprints": op11_fingerprints,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}


def _secret_sql(scope: int = 400) -> str:
    kinds = ", ".join("({}, '{}', '{}')".format(k, name, pattern.replace("'", "''")) for k, (name, pattern) in enumerate(KINDS.items()))
    spans = lambda test: f"coalesce(string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER ({test}), '')"
    near = f"OVER (PARTITION BY rid ORDER BY b RANGE BETWEEN {scope} PRECEDING AND {scope} FOLLOWING)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        k AS (SELECT * FROM (VALUES {kinds}) v(kind, name, pat)),
        f AS (SELECT rid, kind, name, pat, regexp_extract_all(t, pat) AS ms, string_split_regex(t, pat) AS gaps FROM d CROSS JOIN k),
        u AS (SELECT rid, kind, name, pat, gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM f WHERE len(ms) > 0),
        p AS (SELECT rid, kind, name, m, CAST(sum(length(gaps[i]) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS e,
                     CASE kind WHEN 0 THEN length(regexp_extract(m, pat, 2)) >= 8 WHEN 1 THEN length(m) >= 16
                          WHEN 3 THEN length(m) = 40 AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')
                          ELSE true END AS holds FROM u),
        h AS (SELECT rid, kind, name, e - length(m) AS b, e FROM p WHERE holds),
        w AS (SELECT *, count(*) FILTER (kind = 1) {near} AS n_access, count(*) FILTER (kind IN (0, 3)) {near} AS n_secret,
                     coalesce(max(CASE WHEN kind = 0 THEN e END) OVER (PARTITION BY rid ORDER BY b, kind ROWS UNBOUNDED PRECEDING) > b, false) AS inside FROM h),
        l AS (SELECT * FROM w WHERE kind < 3 OR (kind = 3 AND n_access > 0 AND NOT inside) OR (kind = 4 AND n_access > 0 AND n_secret > 0)),
        g AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS x, {spans("kind < 3")} AS base, {spans("true")} AS spans FROM l GROUP BY rid)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN g USING (rid)
    """


def _quality_sql(max_class: float = 0.30, max_word: float = 0.35, min_class: int = 30, min_word: int = 100) -> str:
    lists = " ".join("WHEN '{}' THEN [{}]".format(k, ", ".join(f"'{w}'" for w in ws)) for k, ws in COMMON_WORDS.items())
    known = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    space = r"[\x20\x09-\x0D]"
    parts = ", ".join("length(t) - length(regexp_replace(t, '[{}]+', '', 'g'))".format(c.replace("'", "''")) for c in CLASSES)
    shares = lambda x: f"list_transform({x}, lambda v: v / list_sum({x}))"
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    distance = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({shares(p)}, {shares(q)}), lambda z: {half('z[1]', 'z[2]')} + {half('z[2]', 'z[1]')})) / 2, 0))"
    n_class, n_common = len(CLASSES) + 1, N_WORDS + 1
    sums = lambda x, n: "[" + ", ".join(f"sum({x}[{k + 1}])" for k in range(n)) + "]"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE 'other' END AS lg FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
                     ' ' || lower(regexp_replace(t, '[^\\p{{L}}]+', '  ', 'g')) || ' ' AS plain, CASE lg {lists} ELSE [] END AS cw FROM d),
        g AS (SELECT rid, i, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) AS gram, unnest(range(1, len(ws) - 3)) AS pos FROM (SELECT rid, 0 AS i, ws FROM w WHERE len(ws) >= 5)),
        twice AS (SELECT rid, pos FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
        cover AS (SELECT rid, count(DISTINCT pos + o) AS n FROM twice CROSS JOIN range(5) r(o) GROUP BY rid),
        c AS (SELECT rid, lg, len(ws) AS nw, list_concat(x, [greatest(length(t) - list_sum(x), 0)]) AS cl,
                     list_transform(range(1, {N_WORDS} + 1), lambda k: CASE WHEN len(cw) = 0 THEN 0 ELSE (strlen(plain) - strlen(replace(plain, ' ' || cw[k] || ' ', ''))) // (strlen(cw[k]) + 2) END) AS hw
              FROM (SELECT *, [{parts}] AS x FROM w)),
        h AS (SELECT rid, lg, nw, cl, list_concat(hw, [greatest(nw - list_sum(hw), 0)]) AS co FROM c),
        ref AS (SELECT lg, {sums("cl", n_class)} AS rc, {sums("co", n_common)} AS rw FROM h GROUP BY lg),
        j AS (SELECT rid, CASE WHEN list_sum(cl) > 0 AND list_sum(rc) > 0 THEN {distance("cl", "rc")} END AS dc, CASE WHEN list_sum(co) > 0 AND list_sum(rw) > 0 THEN {distance("co", "rw")} END AS dw
              FROM h JOIN ref USING (lg)),
        b AS (SELECT w.rid, doc_id, lg, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                     CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cover USING (rid))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ((n_words >= {min_class} AND coalesce(dc, 0) > {max_class}) OR (n_words >= {min_word} AND lg <> 'other' AND coalesce(dw, 0) > {max_word})) AS kept
        FROM b JOIN j USING (rid)
    """


def _jaccard_sql(width: int = 3, percent: int = 90) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({lower}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(ws) - {width} + 2), lambda k: array_to_string(ws[k:k + {width - 1}], ' '))) END AS gs FROM w),
        n AS (SELECT doc_id, len(gs) AS n FROM s), u AS (SELECT doc_id, unnest(gs) AS g FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * same >= {percent} * (x.n + y.n - same)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT r.a AS doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM r JOIN n ON n.doc_id = r.a GROUP BY r.a
    """


ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    "op3_secret_scan": _secret_sql(),
    "op4_quality_rules": _quality_sql(),
    "op5_jaccard_join": _jaccard_sql(),
}
