"""Line dedup by site-relative frequency.

Pages are grouped by host; a line's ratio is the number of the host's pages that hold it over the host's
pages. Lines above the ratio (and on `min_pages` pages at least) are dropped from every page of that host.

Lines are compared without surrounding blanks and by two independent 64-bit hashes; a page counts once for
a line. Counts are combined before the shuffle, so a host with a third of all pages costs no more than
others. The boilerplate lines found go back to the pages by a broadcast if there are at most MOST_KEYS of them in
all (16 bytes each) and no host has more than MOST_LISTED; else the lines of numbered pages meet them by host and line, hot
lines dealt out, and each page is told the places of its own lines that go. No join gathers the pages of a host.

Defined cases: null text counts as empty and stays null; a page without a host (null) belongs to no site and
stays whole; blank lines are neither counted nor dropped; repeated rows are pages of their own; an
empty table gives an empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, materialise

MAX_RATIO, MIN_PAGES = 0.05, 5
#: Boilerplate lines (16 bytes each) of all hosts together up to which they are broadcast.
MOST_KEYS = 200_000
#: Boilerplate lines of a host up to which each of its pages is given the list of all of them.
MOST_LISTED = 500
#: Scheme and user of a URL, and its host.
_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)"


def site(source: Column) -> Column:
    """The host of a URL, in lower case; any other name as it is."""
    host = F.regexp_extract(source, _URL, 2)
    return F.when(host != "", F.lower(host)).otherwise(source)


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g"))


def _lines(text: Column) -> Column:
    """Keys of the different lines of a text."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _trimmed)
    return F.transform(F.array_distinct(F.filter(bare, lambda x: x != "")), _key)  # strings are told apart by hashing, structs by pairs


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, n): the hashes of the lines that more than max_ratio, and at least min_pages, of the host's pages hold, n in number."""
    sited = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    total = sited.groupBy("host").agg(F.count("*").alias("pages"))
    lines = sited.select("host", F.explode(_lines(F.col("text"))).alias("key"))
    often = lines.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return often.join(total, "host").where(F.col("n") > F.col("pages") * max_ratio).select("host", "key", "n")


def _listed(pages: DataFrame, found: DataFrame, host: str, text: str) -> DataFrame:
    """pages with __line, the lines of their text, and __kept, those that stay; each page is given all keys of its host."""
    listed = found.groupBy(F.col("host").alias("__host")).agg(F.collect_list("key").alias("__keys"))
    line = F.split(F.col(text), "\n")
    kept = F.filter(line, lambda x: F.col("__keys").isNull() | (_trimmed(x) == "") | ~F.array_contains(F.col("__keys"), _key(_trimmed(x))))
    return pages.join(F.broadcast(listed), F.col(host) == F.col("__host"), "left").withColumns({"__line": line, "__kept": kept}).drop("__host", "__keys")


def _met(pages: DataFrame, found: DataFrame, host: str, text: str) -> DataFrame:
    """What _listed() gives; each line meets its own key, and each page is given the places of its lines that go."""
    numbered = materialise(pages.withColumns({"__id": F.monotonically_increasing_id(), "__line": F.split(F.col(text), "\n")}))  # written, so that numbers hold
    lines = numbered.where(F.col(host).isNotNull()).select("__id", F.col(host).alias("host"), F.posexplode("__line").alias("at", "line")).withColumn("line", _trimmed(F.col("line")))
    gone = join_by_key(lines.where("line <> ''").select("__id", "host", "at", _key(F.col("line")).alias("key")), found, ["host", "key"], "n")
    gone = gone.groupBy("__id").agg(F.collect_list("at").alias("__gone"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__line") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col("__line")).otherwise(F.transform(places, lambda k: F.get("__line", k)))
    return numbered.join(gone, "__id", "left").withColumn("__kept", kept).drop("__id", "__gone")


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with their text cleaned, and with __lines and __dropped, the numbers of lines before and of lines dropped."""
    found = materialise(boilerplate(pages, host, text, max_ratio, min_pages))
    keys, longest = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    few = (keys or 0) <= MOST_KEYS and (longest or 0) <= MOST_LISTED
    cleaned = (_listed if few else _met)(pages, found, host, text)
    counts = {"__lines": F.coalesce(F.size("__line"), F.lit(0)).cast("long"), "__dropped": F.coalesce(F.size("__line") - F.size("__kept"), F.lit(0)).cast("long")}
    return cleaned.withColumns({text: F.when(F.col(text).isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")), **counts}).drop("__line", "__kept")


def query(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and its text without boilerplate; `source` names the site, or is a URL of it."""
    pages = docs.select("doc_id", site(F.col("source")).alias("host"), "text")
    return drop_boilerplate(pages).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")


def stage(docs: DataFrame) -> DataFrame:
    """docs with cleaned text and n_chars to match; every document stays."""
    out = drop_boilerplate(docs.withColumn("__site", site(F.col("source"))), host="__site")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_extract(source, '{_URL}', 2) <> '' THEN lower(regexp_extract(source, '{_URL}', 2)) ELSE source END AS source, text, row_number() OVER () AS page FROM documents
), raw_lines AS (
  SELECT doc_id, source, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d
), lines AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM raw_lines
), sizes AS (
  SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source
), often AS (
  SELECT source, bare FROM (SELECT source, bare, count(DISTINCT page) AS n FROM lines WHERE bare <> '' AND source IS NOT NULL GROUP BY source, bare)
  JOIN sizes USING (source) WHERE n >= {MIN_PAGES} AND n > pages * CAST({MAX_RATIO} AS DOUBLE)
), marked AS (
  SELECT l.*, o.bare IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.source = o.source AND l.bare = o.bare
), built AS (
  SELECT page, count(*) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dropped,
         coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY k), '') AS text
  FROM marked GROUP BY page
)
SELECT d.doc_id, coalesce(b.n_lines, 0) AS n_lines, coalesce(b.n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE b.text END AS text
FROM d LEFT JOIN built b ON d.page = b.page
"""
