"""Scalar functions: text clean-up, slugs, URLs, similarity, money and dates, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Tables, query


def html_to_text(html: Column) -> Column:
    """The text of a page: no navigation, scripts and tags; entities decoded (the ampersand first); white space as one blank."""
    bare = html
    for tag in ("script", "style", "nav", "header", "footer"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return squeezed(bare)


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_form(name: Column) -> Column:
    """The form that names are compared in: lower case, blanks, dashes and underscores as one blank."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\s_-]+", " "))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "(^-+)|(-+$)", "")


def token_count(text: Column) -> Column:
    """A quarter of the characters, rounded up: the usual estimate of language-model tokens."""
    return (F.length(text) + 3).cast("long") / F.lit(4)


@query("strf01_html_text", r"""SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<nav\b.*?</nav>', ' ', 'gis'), '<header\b.*?</header>', ' ', 'gis'), '<footer\b.*?</footer>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g'))) AS text_sha FROM pages""")
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2(html_to_text(F.col("html")), 256).alias("text_sha"))


@query("strf04_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '(^-+)|(-+$)', '', 'g') AS slug FROM part")
def slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", slug(F.col("p_name")).alias("slug"))


@query("strf07_normal_form", r"SELECT c_custkey, trim(regexp_replace(lower(c_name || ' _-X'), '[\s_-]+', ' ', 'g')) AS name FROM customer")
def normal_forms(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", normal_form(F.concat("c_name", F.lit(" _-X"))).alias("name"))


@query("strf12_url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(t: Tables) -> DataFrame:
    url = F.col("url")
    patterns = {"scheme": r"^([a-z]+)://", "host": r"^[a-z]+://([^/?#]+)", "path": r"^[a-z]+://[^/?#]+([^?#]*)"}
    return t.pages.select("page_id", *(F.regexp_extract(url, p, 1).alias(n) for n, p in patterns.items()))


@query("strf15_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"))


@query("strf18_counts", r"SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '[A-Z]')) AS capitals FROM documents")
def counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("capitals"))


@query("datf01_dates", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, o_orderdate - INTERVAL 7 DAY AS week_before, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dates(t: Tables) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", month.alias("month"), F.expr("o_orderdate - INTERVAL 7 DAYS").alias("week_before"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("math01_clamp", "SELECT event_id, least(1.0, greatest(0.0, value / 50)) AS clamped, round_even(value, 0) AS rounded FROM events")
def clamp(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 50)).alias("clamped"), F.bround("value", 0).alias("rounded"))


@query("math02_tokens", "SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimates(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.floor(token_count(F.col("text"))).alias("tokens"))


@query("arrf02_list_field", "SELECT p_partkey, list_filter(list_transform(string_split(p_type || ', ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part")
def list_field(t: Tables) -> DataFrame:
    raw = F.concat("p_type", F.lit(", ,"), "p_brand")
    return t.part.select("p_partkey", F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "").alias("parts"))


@query("jsnf01_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
