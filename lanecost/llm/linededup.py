"""Line dedup by site-relative frequency.

A line is boilerplate on a host when more than ``ratio`` of the host's pages contain it, and
at least ``min_pages`` pages do. Pages of equal text count once, in both numbers: copies of a story
are not boilerplate of its site. They are merged by the digest of the text first, as digests
of lines; then counting shuffles one row per distinct (host, line) of a task, so neither a hot host, a
much copied page nor a common line meets in one task. The flagged lines of a host are an array; since the shares of a host's lines add up to
its mean number of distinct lines per page, it holds at most (that mean / ratio) digests,
whatever the number of pages. It is joined by host; Spark broadcasts it only if the written
table is measured to be small and otherwise splits a skewed host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, written


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, text: str, host: str, ratio: float, min_pages: int) -> DataFrame:
    """One row per host with flagged lines: host, digests, pages. Blank lines are never flagged."""
    line = F.transform(F.filter(F.array_distinct(_lines(F.col(text))), lambda x: F.trim(x) != ""), lambda x: F.md5(x.cast("binary")))
    slim = pages.select(F.col(host).alias("host"), F.md5(F.col(text).cast("binary")).alias("page"), line.alias("lines"))
    distinct = written(slim.groupBy("host", "page").agg(F.first("lines").alias("lines")))
    totals = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = distinct.select("host", F.explode("lines").alias("digest")).groupBy("host", "digest").agg(
        F.count(F.lit(1)).alias("holding")).where(F.col("holding") >= min_pages)
    totals, counts = totals.alias("t"), counts.alias("c")
    common = counts.join(totals, F.col("c.host").eqNullSafe(F.col("t.host"))).where(
        F.col("holding") > F.lit(float(ratio)) * F.col("pages"))
    return common.groupBy("t.host").agg(F.collect_list("digest").alias("digests"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.03,
                     min_pages: int = 5, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``pages`` without the lines that are boilerplate on their host.

    ``text`` keeps its other lines in order; ``n_lines`` and ``n_dropped`` are added (and
    replace columns of these names). A null text stays null, with 0 lines; an empty text has
    one blank line. Null hosts are a host of their own. Repeated rows and equal texts of a host count as
    one page, all null texts too. A text that only holds boilerplate becomes empty, its row stays.
    """
    flagged = written(boilerplate(pages, text, host, ratio, min_pages))
    site, digests = fresh("site"), fresh("digests")
    flagged = flagged.select(F.col("host").alias(site), F.col("digests").alias(digests))
    joined = pages.drop(n_lines, n_dropped).join(flagged, F.col(f"`{host}`").eqNullSafe(F.col(site)), "left")
    kept = F.filter(_lines(F.col(text)), lambda line: ~F.array_contains(digests, F.md5(line.cast("binary"))))
    row = fresh("kept")
    out = joined.withColumn(row, F.when(F.col(digests).isNotNull(), kept).otherwise(_lines(F.col(text))))
    lines = F.size(_lines(F.col(text)))
    total = F.when(F.col(text).isNull(), 0).otherwise(lines)
    left = F.when(F.col(text).isNull(), 0).otherwise(F.size(row))
    columns = [F.array_join(row, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in pages.drop(n_lines, n_dropped).columns]
    return out.select(*columns, total.cast("long").alias(n_lines), (total - left).cast("long").alias(n_dropped))


def oracle(ratio: float, min_pages: int) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source),
c AS (SELECT source, line, count(*) AS holding
      FROM (SELECT DISTINCT source, text, unnest(lines) AS line FROM d) WHERE trim(line) <> '' GROUP BY source, line),
b AS (SELECT c.source, list(line) AS flagged FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE holding >= {min_pages} AND holding > {ratio}::DOUBLE * pages GROUP BY c.source),
j AS (SELECT d.*, list_filter(lines, lambda x: NOT list_contains(coalesce(flagged, []::VARCHAR[]), x)) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped FROM j"""
