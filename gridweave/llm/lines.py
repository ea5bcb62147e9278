"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

_SPACES = "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of the trimmed line, as text of two hashes."""
    t = F.regexp_replace(line, _SPACES, "")
    return F.concat_ws(":", F.xxhash64(t), F.xxhash64(t, F.lit(1)))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, keys array<string>): trimmed lines on more than ratio of the host's pages and on min_pages or more.

    A page counts once for a line. Counts are pre-aggregated where the pages lie. A host keeps at most
    (mean lines of a page) / ratio keys, however many pages it has.
    """
    base = pages.select(F.col(host).alias("__host"), F.col(text).alias("__text"))
    totals = base.groupBy("__host").agg(F.count("*").alias("__pages"))
    totals = materialize(totals.where(F.col("__pages") >= min_pages))
    keyed = F.array_distinct(F.transform(F.filter(_lines(F.col("__text")), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), _key))
    counts = base.select("__host", F.explode(keyed).alias("__key")).groupBy("__host", "__key").agg(F.count("*").alias("__n"))
    counts = counts.where(F.col("__n") >= min_pages)
    small = broadcast_if_small(totals, totals.count(), 128)
    often = counts.join(small.withColumnRenamed("__host", "__h"), F.col("__host").eqNullSafe(F.col("__h"))).where(F.col("__n") > ratio * F.col("__pages"))
    return often.groupBy("__host").agg(F.sort_array(F.collect_set("__key")).alias("__keys"))


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = 0.1, min_pages: int = 5, spare_whole: bool = False) -> DataFrame:
    """pages with text stripped of boilerplate lines, plus n_lines (with a word) and n_dropped.

    spare_whole leaves texts as they are that would lose every line: a page copied often isn't boilerplate of others, and
    removing copies is not this operator's work. Null texts stay null with no lines; a null host is a host of its own. Blank lines stay. Hosts with fewer than min_pages
    pages lose nothing. Repeated rows count as pages of their own and are stripped alike. An empty table gives no
    rows. Columns named __* are the operator's own; n_lines and n_dropped replace columns of these names; any other keeps its value.
    """
    bad = materialize(boilerplate(pages, host, text, ratio, min_pages))
    n = bad.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("__keys")), F.lit(0)).alias("keys")).first()
    bad = broadcast_if_small(bad.withColumnRenamed("__host", "__h"), n["rows"] + n["keys"], 64)
    df = pages.join(bad, F.col(host).eqNullSafe(F.col("__h")), "left")
    lines = F.transform(_lines(F.col(text)), lambda x: F.struct(x.alias("line"), x.rlike("[^\\x20\\x09-\\x0D]").alias("real")))
    marked = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["real"].alias("real"), (x["real"] & F.array_contains("__keys", _key(x["line"]))).alias("bad")))
    df = df.withColumn("__marked", F.when(F.col("__keys").isNotNull(), marked).otherwise(F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["real"].alias("real"), F.lit(False).alias("bad")))))
    m = F.col("__marked")
    real = F.size(F.filter(m, lambda x: x["real"])).cast("long")
    dropped = F.size(F.filter(m, lambda x: x["bad"])).cast("long")
    kept = F.array_join(F.transform(F.filter(m, lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
    out = df.withColumns({"__real": real, "__dropped": dropped})
    if spare_whole:
        out = out.withColumn("__dropped", F.when(F.col("__dropped") == F.col("__real"), F.lit(0)).otherwise(F.col("__dropped")).cast("long"))
    new = F.when(F.col("__dropped") > 0, kept).otherwise(F.col(text))
    return out.select(*[new.alias(c) if c == text else F.col(c) for c in pages.columns if c not in ("n_lines", "n_dropped")], F.col("__real").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


def page_text(html: Column) -> Column:
    """Visible text of raw HTML, a line for each block element; patterns that RE2 engines read alike."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    t = F.regexp_replace(t, "</?(p|div|h1|h2|h3|h4|li|ul|ol|nav|article|footer|header|br|title|head|body|html|tr|table|section)( [^>]*)?/?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, plain in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return t


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z]+://([^/?#]+)", 1))


def op2(pages: DataFrame, ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    df = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), page_text(F.col("html")).alias("text")))  # HTML is taken apart once
    return drop_boilerplate(df, "host", "text", ratio, min_pages)


OP2_SQL = r"""
WITH t0 AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/?#]+)', 1)) AS host,
  regexp_replace(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS h FROM pages),
t1 AS (SELECT page_id, host, regexp_replace(regexp_replace(h, '</?(p|div|h1|h2|h3|h4|li|ul|ol|nav|article|footer|header|br|title|head|body|html|tr|table|section)( [^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS h FROM t0),
t AS (SELECT page_id, host, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS text FROM t1),
l AS (SELECT page_id, host, u.i AS i, u.line AS line, regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k,
  regexp_matches(u.line, '[^\x20\x09-\x0D]') AS real_line
  FROM (SELECT page_id, host, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'i': i})) AS u FROM t)),
c AS (SELECT host, k, count(DISTINCT page_id) AS n FROM l WHERE real_line GROUP BY host, k),
p AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
b AS (SELECT c.host, c.k, true AS bad FROM c JOIN p ON c.host = p.host WHERE n >= 5 AND n > 0.1 * pages),
m AS (SELECT l.*, real_line AND coalesce(bad, false) AS dropped FROM l LEFT JOIN b ON l.host = b.host AND l.k = b.k)
SELECT page_id, host, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text,
  CAST(count(*) FILTER (real_line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped
FROM m GROUP BY page_id, host
"""
