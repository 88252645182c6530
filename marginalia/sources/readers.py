"""Sources: anchors and feeds in pages, page scans of JSON, settings, embedded JSON in text, printed words to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..registry import Tables, query


def read_json_pages(spark: SparkSession, folder: str, schema: StructType | str, field: str | None = None) -> DataFrame:
    """All pages of a JSON listing that were stored in ``folder``; rows that don't fit the schema become nulls.

    A page is a file of rows, or with ``field`` a line whose ``field`` is the array of its rows, so that a file holds many pages.
    """
    if field is None:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder)
    told = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(f"`{field}` array<struct<{told}>>").option("mode", "PERMISSIVE").json(folder).select(F.inline(field))


def setting(stored: Column, environment: str | None, default: str) -> Column:
    """A setting: the stored value over that of the environment over the default."""
    return F.coalesce(stored, F.lit(environment), F.lit(default))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, title) of the links of each page."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"))
    rows = pages.select("page_id", F.posexplode(tags).alias("pos", "tag"))
    title = F.trim(F.regexp_replace(F.regexp_replace("tag", r"(?s)<[^>]+>", " "), r"\s+", " "))
    return rows.select("page_id", "pos", F.regexp_extract("tag", r"""(?i)href\s*=\s*["']?([^"'\s>]+)""", 1).alias("href"), title.alias("title"))


def page_lines(words: DataFrame, height: float = 3.0) -> DataFrame:
    """(page, line, text) of printed ``words`` (page, x, y, text): words of about one height are a line, left to right, top to bottom."""
    line = F.bround(F.col("y") / height, 0)
    return words.groupBy("page", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("text"))


_TAGS = r"(SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*>.*?</a>', 0, 'is')) AS tag FROM pages)"
_HREF = r"""regexp_extract(tag, 'href\s*=\s*["'']?([^"''\s>]+)', 1, 'i')"""


@query("src07_anchors", f"SELECT page_id, {_HREF} AS href FROM {_TAGS}")
def page_anchors(t: Tables) -> DataFrame:
    return anchors(t.pages).select("page_id", "href")


@query("src06_first_link", f"SELECT page_id, count(*) AS links, min({_HREF}) AS least_href FROM {_TAGS} GROUP BY page_id")
def first_link(t: Tables) -> DataFrame:
    return anchors(t.pages).groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("least_href"))


@query("src08_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS category FROM pages")
def titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://[^/]+/([^/?#]+)", 1).alias("category"))


@query("src12_json_rows", "SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events")
def json_rows(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("k"))


@query("src15_settings", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'DEFAULT') AS segment FROM customer")
def settings(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", setting(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), None, "DEFAULT").alias("segment"))


@query("src05_page_lines", "SELECT l_orderkey AS page, round_even(l_quantity / 3, 0) AS line, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY 1, 2")
def printed_lines(t: Tables) -> DataFrame:
    return page_lines(t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("y"), F.col("l_returnflag").alias("text")))


def pdf_links(pages: DataFrame, keyword: str) -> DataFrame:
    """(page_id, href): the link to a PDF whose address or text has ``keyword``, the first on the page; the only PDF of a page where none has it."""
    pdfs = anchors(pages).where(F.col("href").rlike(r"(?i)\.pdf($|[?#])"))
    hit = F.contains(F.lower("href"), F.lit(keyword)) | F.contains(F.lower("title"), F.lit(keyword))
    per = pdfs.groupBy("page_id").agg(F.min_by("href", F.when(hit, F.col("pos"))).alias("named"), F.min("href").alias("only"), F.count("*").alias("n"))
    return per.select("page_id", F.coalesce("named", F.when(F.col("n") == 1, F.col("only"))).alias("href")).where("href IS NOT NULL")


def hub_pages(pages: DataFrame, base: str, kinds: dict[str, str]) -> DataFrame:
    """(page_id, url, title, kind): links whose title has one of ``kinds`` (words, kind), https only and no PDFs, with their fragments
    left out; of links that differ in a slash at the end the first one stands."""
    kind = F.lit(None).cast("string")
    for words, name in reversed(list(kinds.items())):
        kind = F.when(F.contains(F.lower("title"), F.lit(words)), name).otherwise(kind)
    url = F.regexp_replace(F.when(F.col("href").startswith("/"), F.concat(F.lit(base), "href")).otherwise(F.col("href")), "#.*$", "")
    rows = anchors(pages).select("page_id", "pos", url.alias("url"), "title", kind.alias("kind"))
    rows = rows.where("kind IS NOT NULL AND length(title) BETWEEN 1 AND 160 AND url LIKE 'https://%'").where(~F.col("url").rlike(r"(?i)\.pdf($|\?)"))
    first = rows.groupBy("page_id", F.rtrim(F.lower("url"), F.lit("/")).alias("key")).agg(F.min_by(F.struct("url", "title", "kind"), "pos").alias("r"))
    return first.select("page_id", "r.url", "r.title", "r.kind")


_PDFS = r"(SELECT page_id, pos, tag, regexp_replace(regexp_extract(tag, 'href=\"([^\"]+)\"', 1), '^(/[A-Za-m][a-z]*)$', '\1.pdf') AS href, trim(regexp_replace(regexp_replace(tag, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT page_id, i - 1 AS pos, tags[i] AS tag FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*>.*?</a>', 0, 'is') AS tags FROM pages), unnest(range(1, len(tags) + 1)) AS u(i)))".replace('\\"', '"')


def with_pdfs(t: Tables) -> DataFrame:
    """The pages with some of their links made PDFs."""
    return t.pages.select("page_id", F.regexp_replace("html", r'href="(/[A-Za-m][a-z]*)"', r'href="$1.pdf"').alias("html"))


@query("src06_pdf_links", f"WITH a AS {_PDFS}, p AS (SELECT page_id, pos, href, contains(lower(href), 'and') OR contains(lower(title), 'and') AS hit FROM a WHERE href LIKE '%.pdf') SELECT page_id, coalesce(arg_min(href, pos) FILTER (hit), CASE WHEN count(*) = 1 THEN min(href) END) AS href FROM p GROUP BY page_id HAVING coalesce(arg_min(href, pos) FILTER (hit), CASE WHEN count(*) = 1 THEN min(href) END) IS NOT NULL")
def pdf_of_page(t: Tables) -> DataFrame:
    return pdf_links(with_pdfs(t), "and")


@query("src07_hub_pages", rf"WITH a AS {_PDFS}, u AS (SELECT page_id, pos, regexp_replace(CASE WHEN href LIKE '/%' THEN 'https://hub.example.org' || href ELSE href END, '#.*$', '') AS url, title, CASE WHEN contains(lower(title), 'tion') THEN 'notes' WHEN contains(lower(title), 'e') THEN 'errata' END AS kind FROM a) SELECT page_id, url, title, kind FROM u WHERE kind IS NOT NULL AND length(title) BETWEEN 1 AND 160 AND url LIKE 'https://%' AND NOT regexp_matches(url, '(?i)\.pdf($|\?)') QUALIFY row_number() OVER (PARTITION BY page_id, rtrim(lower(url), '/') ORDER BY pos) = 1")
def hub(t: Tables) -> DataFrame:
    return hub_pages(with_pdfs(t), "https://hub.example.org", {"tion": "notes", "e": "errata"})
