"""Line deduplication by frequency within a site.

A page's lines are its texts between tags and line ends. Within a host, the pages that contain a line over the
host's pages is the line's frequency; lines above ``ratio`` are boilerplate and go. A host needs ``min_pages`` pages
for a ratio to mean something, and a line ``min_hits``.

Counts are combined in the tasks before the exchange and dealt by host and line, so neither a host of a third of all
pages nor a line of every page meets in one task. A host has at most (lines a page) / ratio boilerplate lines, so
its list is short; it is joined to the pages, whose texts do not move if all lists together are small. Else pages meet
their host's list; those of a host with more than 1 / HOT of all pages are dealt over several places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import stored

RATIO, MIN_PAGES, MIN_HITS = 0.3, 5, 3
#: Boilerplate lines of all hosts (16 bytes each) up to which their lists are broadcast.
BROADCAST_LINES = 1_000_000
#: A host has one place for each 1 / HOT of all pages; fewer than HOT hosts have several.
HOT = 1000

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]+)"
SKIPPED = r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)"
EDGES = r"^[ \t\r]+|[ \t\r]+$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), SKIPPED, "\n"), "<[^>]*>", "\n")
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(lines: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, min_hits: int = MIN_HITS) -> DataFrame:
    """(host, digest, hits, pages) of boilerplate lines. ``lines``: host string, lines array<string>, a row a page."""
    digests = lines.select("host", F.array_distinct(F.transform("lines", _digest)).alias("ds"))
    totals = digests.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    hits = digests.select("host", F.explode("ds").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)
    return hits.join(totals, "host").where(F.col("hits") > ratio * F.col("pages"))


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_hits: int = MIN_HITS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row a page: page_id, host, n_lines, n_dropped, text (lines kept, joined by line feeds).

    Null urls share the host ''; null html has no lines. A line that one page repeats counts once for it, and all
    its copies go or stay. Repeated rows count as pages of their own. Other columns are ignored.
    """
    own = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(pages[url_col]).alias("host"), lines_of(pages[html_col]).alias("lines"))
    found = stored(boilerplate(own, ratio, min_pages, min_hits).select("host", "digest", "pages"), "lines")
    n = found.count()
    lists = found.groupBy("host").agg(F.collect_list("digest").alias("drop"), F.max("pages").alias("pages"))
    if n <= broadcast_lines:
        joined = own.join(F.broadcast(lists.select("host", "drop")), "host", "left")
    else:
        total = pages.count()
        places = F.ceil(F.col("pages") * HOT / F.lit(total)).cast("int")
        lists = lists.withColumn("places", places).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
        hot = lists.where("places > 1 AND place = 0").select(F.col("host").alias("hot"), F.col("places").alias("of"))  # fewer than HOT rows
        dealt = own.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left").withColumn("place", F.pmod(F.xxhash64("page_id", "lines"), F.coalesce("of", F.lit(1))).cast("int"))
        joined = dealt.join(lists.select("host", "place", "drop").hint("merge"), ["host", "place"], "left")
    # the few digests that the page shares with its host's list, by a hash set; lines are compared with these only
    gone = F.array_intersect(F.transform("lines", _digest), "drop")
    joined = joined.withColumn("gone", F.when(F.col("drop").isNotNull(), gone))
    kept = F.when(F.coalesce(F.size("gone"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("gone", _digest(x))))
    return joined.select("page_id", "host", "lines", kept.alias("kept")).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )


ORACLE = rf"""
WITH a AS (SELECT page_id, row_number() OVER () AS row, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    regexp_replace(regexp_replace(coalesce(html, ''), '{SKIPPED[5:]}', chr(10), 'gis'), '<[^>]*>', chr(10), 'g') AS bare FROM pages),
  b AS (SELECT page_id, row, host, list_filter(list_transform(string_split(bare, chr(10)), lambda x: regexp_replace(x, '{EDGES}', '', 'g')), lambda x: x <> '') AS lines FROM a),
  t AS (SELECT host, count(*) AS pages FROM b GROUP BY host),
  h AS (SELECT host, line, count(*) AS hits FROM (SELECT DISTINCT row, host, unnest(lines) AS line FROM b) AS x GROUP BY host, line),
  d AS (SELECT host, list(line) AS gone FROM h JOIN t USING (host) WHERE pages >= {MIN_PAGES} AND hits >= {MIN_HITS} AND hits > {RATIO} * pages GROUP BY host),
  k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept FROM b LEFT JOIN d USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
