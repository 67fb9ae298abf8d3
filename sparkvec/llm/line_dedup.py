"""Line dedup: cross-site boilerplate lines go, by HyperLogLog spread of each line hash.

A line is its text without white space at its ends. One aggregation merges, for each line hash, a HyperLogLog
sketch of the sites (``source``) that carry it and its first occurrence. Where the estimate is near the threshold, the exact
number of distinct sites decides. A line found on ``min_sites`` sites or more is boilerplate: it goes from every
document but stays at its first occurrence (smallest doc_id, then position), so that no text leaves the corpus.

Defined results: null text stays null and has no lines; blank lines are never boilerplate; a null source is one
site of its own; rows that repeat a doc_id count as the same document, so they keep a line together; an empty table gives no
rows; all other columns of ``docs`` pass through, n_chars brought up to date. Line hashes have 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import cut, table

MIN_SITES = 10
#: Share of the threshold by which an estimate may miss it and be counted exactly; lg_k 12 errs by about 1.6 %.
BAND = 0.25
LG_K = 12
#: Lines near the threshold that are broadcast, at most.
MAX_BROADCAST = 1_000_000
#: Boilerplate lines that are put into the scan as a literal set, at most; beyond that they are joined.
MAX_LITERAL = 20_000
BLANK = " \t\x0b\f\r"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _lines(docs: DataFrame) -> DataFrame:
    return (
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("site"), F.xxhash64("text").alias("digest"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", "site", "digest", "pos", _key(F.col("line")).alias("key"))
        .where("key <> ''")
        .select("doc_id", "site", "digest", "pos", F.xxhash64("key").alias("h"))
    )


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(h, doc_id, pos): the hash of each boilerplate line and its first occurrence.

    Only lines whose estimate is near the threshold are counted exactly. Up to ``max_broadcast`` of them, eight bytes each, are
    sent to the lines, so that only theirs are shuffled, one row for each site; more are joined, with the same result."""
    lines = _lines(docs)
    spread = cut(
        lines.groupBy("h")
        .agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("h", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - band))
    )
    near = spread.where(F.col("sites") < min_sites * (1 + band)).select("h")
    n = near.limit(max_broadcast + 1).count()
    if n == 0:
        return spread.where(F.col("sites") >= min_sites).select("h", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"))
    if n <= max_broadcast:
        pairs = lines.select("h", "site").join(F.broadcast(near), "h", "left_semi").distinct()
    else:  # distinct before the join, so that a line of a third of all rows is a few of them
        pairs = lines.select("h", "site").distinct().join(near, "h", "left_semi")
    exact = pairs.groupBy("h").agg(F.count("*").alias("exact_sites"))
    return (
        spread.join(exact, "h", "left")
        .where(F.coalesce("exact_sites", "sites") >= min_sites)
        .select("h", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"))
    )


def drop_lines(docs: DataFrame, boilerplate: DataFrame, max_literal: int = MAX_LITERAL) -> DataFrame:
    """``docs`` with text without boilerplate, and the counts ``n_lines`` and ``n_removed``.

    Up to ``max_literal`` lines are tested inside the scan by a literal hash set; more are joined by line hash,
    and the positions found by doc_id and text hash, which tell rows apart whose lines differ, with the same result.
    """
    plain = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    few = boilerplate.limit(max_literal + 1).select("h", F.xxhash64("h", "doc_id", "pos").alias("first")).collect()
    if len(few) <= max_literal:
        known = ",".join(f"{r['h']}L" if r["h"] > -(1 << 63) else "(-9223372036854775807L - 1L)" for r in few) or "NULL"
        first = ",".join(f"{r['first']}L" if r["first"] > -(1 << 63) else "(-9223372036854775807L - 1L)" for r in few) or "NULL"
        key = "btrim(x, _blank)"
        keep = f"{key} = '' OR NOT coalesce(xxhash64({key}) IN ({known}), false) OR coalesce(xxhash64(xxhash64({key}), doc_id, i) IN ({first}), false)"
        marked = docs.withColumn("_blank", F.lit(BLANK)).withColumn("_lines", F.split("text", "\n")).withColumn("_kept", F.expr(f"filter(_lines, (x, i) -> {keep})"))
    else:
        bad = (
            _lines(docs)
            .join(boilerplate.select("h", F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos")), "h")
            .where(~(F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("pos") == F.col("_pos"))))
            .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
            .agg(F.collect_set("pos").alias("_bad"))
        )
        lines = F.split("text", "\n")
        at = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_bad", F.array().cast("array<int>")))
        marked = (
            docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest")), "left")
            .withColumn("_lines", lines)
            .withColumn("_kept", F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(F.transform(at, lambda p: F.get("_lines", p))))
        )
    return marked.select(
        *plain,
        F.array_join("_kept", "\n").alias("text"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without cross-site boilerplate lines, with the same columns."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))  # columns may have the names of the counts
    out = drop_lines(rows, boilerplate_lines(docs, min_sites))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs, boilerplate_lines(docs)).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
spread AS (SELECT key, count(DISTINCT site) AS sites FROM keyed WHERE key <> '' GROUP BY key),
ranked AS (
  SELECT k.*, coalesce(s.sites, 0) AS sites, row_number() OVER (PARTITION BY k.key ORDER BY k.doc_id, k.pos) AS nth
  FROM keyed k LEFT JOIN spread s ON k.key = s.key),
judged AS (SELECT *, key <> '' AND sites >= {MIN_SITES} AND nth > 1 AS gone FROM ranked)
SELECT d.doc_id, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM judged GROUP BY doc_id) j ON d.doc_id = j.doc_id
"""
