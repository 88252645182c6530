"""Functions of dates, numbers, arrays, maps and JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Tables, query


def total_days(later: Column, earlier: Column) -> Column:
    """Days from one moment to another with their fraction, 0 at least."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.greatest(F.lit(0.0), (micros(later) - micros(earlier)) / 864e8)


def local_date(at: Column, zone: str) -> Column:
    """The date of a moment in a time zone."""
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))


def iso_moment(at: Column) -> Column:
    """A moment as text with seven places of a second and its offset: sorts as it stands and reads back without loss."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(both / union)


def f1(precision: Column, recall: Column) -> Column:
    """The harmonic mean, 0 where both are."""
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def token_cost(tokens: Column, price: Column) -> Column:
    """Tokens at a price for a million, in decimals; null where either is unknown."""
    return (tokens.cast("decimal(18,0)") * price.cast("decimal(10,6)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,12)")


def unique_spellings(words: Column) -> Column:
    """The words that differ in more than case, in the spelling that comes first."""
    low = F.transform(words, lambda w: F.lower(w))
    return F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def from_csv_field(text: Column) -> Column:
    """The trimmed parts of a comma-separated field that aren't empty."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def json_string(document: Column, field: str) -> Column:
    """A text property, trimmed; null where it is missing, blank or of another kind, or the document can't be read."""
    value = F.try_variant_get(F.try_parse_json(document), f"$.{field}", "variant")
    text = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when((F.schema_of_variant(value) == "STRING") & (text != ""), text)


def json_boolean(document: Column, field: str) -> Column:
    """A true or false property; null where it is missing or of another kind."""
    value = F.try_variant_get(F.try_parse_json(document), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def json_strings(document: Column, field: str) -> Column:
    """The text elements of an array property."""
    value = F.try_variant_get(F.try_parse_json(document), f"$.{field}", "array<variant>")
    return F.transform(F.filter(value, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


#: The phases of an answer, in milliseconds.
PHASES = ("rewriteMs", "embedMs", "retrievalMs", "aiMs", "totalMs")


def phases(document: Column) -> Column:
    """The phases of an answer from its JSON, 0 where one is missing; null where the document can't be read."""
    whole = F.try_parse_json(document)
    return F.when(whole.isNotNull(), F.struct(*(F.coalesce(F.try_variant_get(whole, f"$.{p}", "long"), F.lit(0).cast("long")).alias(p) for p in PHASES)))


@query("datf01_days", "WITH m AS (SELECT max(ts) AS m FROM events) SELECT event_id, date_trunc('day', ts) AS day, ts + INTERVAL 30 DAY AS due, round(greatest(0.0, (epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 864e8), 9) AS age FROM events")
def days(t: Tables) -> DataFrame:
    age = total_days(F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return t.events.select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.expr("ts + INTERVAL 30 DAYS").alias("due"), F.round(age, 9).alias("age"))


@query("datf02_millis", "SELECT event_id, make_timestamp((1704067200000 + event_id * 86400123) * 1000) AS at FROM events")
def millis(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("event_id") * 86_400_123).cast("timestamp_ntz").alias("at"))


@query("datf03_local_dates", "SELECT event_id, CAST(timezone('Europe/Amsterdam', timezone('UTC', ts)) AS DATE) AS day, CAST(timezone('Europe/Amsterdam', timezone('UTC', ts)) AS DATE) = CAST(timezone('Europe/Amsterdam', timezone('UTC', ts + INTERVAL 6 HOUR)) AS DATE) AS same FROM events")
def local_dates(t: Tables) -> DataFrame:
    zone = "Europe/Amsterdam"
    return t.events.select("event_id", local_date(F.col("ts"), zone).alias("day"), (local_date(F.col("ts"), zone) == local_date(F.expr("ts + INTERVAL 6 HOURS"), zone)).alias("same"))


@query("datf04_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS at FROM events")
def iso(t: Tables) -> DataFrame:
    return t.events.select("event_id", iso_moment(F.col("ts")).alias("at"))


@query("math01_curves", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 25)), 9) AS squashed, round(exp(-ln(2) / 30 * value), 9) AS decayed, round(sqrt(value), 9) AS root, round_even(value * 10, 0) / 10 AS even, CAST(floor(value * 0.9) AS BIGINT) AS place FROM events")
def curves(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", F.round(sigmoid((v - 50) / 25), 9).alias("squashed"), F.round(F.exp(-F.log(F.lit(2.0)) / 30 * v), 9).alias("decayed"), F.round(F.sqrt(v), 9).alias("root"), (F.bround(v * 10, 0) / 10).alias("even"), F.floor(v * 0.9).alias("place"))


_SETS = "WITH s AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [] ELSE list_distinct(string_split(lower(p_name), ' ')) END AS a, CASE WHEN p_size % 2 = 0 THEN [] ELSE list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) END AS b FROM part)"


def _sets(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    return t.part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, none).otherwise(words(F.col("p_name"))).alias("a"), F.when(F.col("p_size") % 2 == 0, none).otherwise(words(F.concat_ws(" ", "p_name", "p_type"))).alias("b"))


@query("math03_jaccard", _SETS + " SELECT p_partkey, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS alike FROM s")
def jaccard(t: Tables) -> DataFrame:
    return _sets(t).select("p_partkey", set_similarity(F.col("a"), F.col("b")).alias("alike"))


@query("math04_f1", "SELECT l_orderkey, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') / count(*) AS p, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') / count(*) AS r FROM lineitem GROUP BY 1)")
def f1_scores(t: Tables) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    per = t.lineitem.groupBy("l_orderkey").agg((F.count_if(returned) / F.count("*")).alias("p"), (F.count_if(returned & (F.col("l_linestatus") == "F")) / F.count("*")).alias("r"))
    return per.select("l_orderkey", F.round(f1(F.col("p"), F.col("r")), 9).alias("f1"))


@query("math05_decimal_cost", "SELECT o_orderkey, CAST(CAST(o_orderkey * 1000 + 7 AS DECIMAL(18,0)) * CAST(round(o_totalprice / 1000, 6) AS DECIMAL(10,6)) * CAST('0.000001' AS DECIMAL(7,6)) AS DOUBLE) AS usd FROM orders")
def decimal_cost(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", token_cost(F.col("o_orderkey") * 1000 + 7, F.round(F.col("o_totalprice") / 1000, 6)).cast("double").alias("usd"))


@query("arrf01_arrays", r"""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || upper(p_name) || ' ' || p_type, ' ') AS w, string_split(lower(p_type || ' small large'), ' ') AS v FROM part)
    SELECT p_partkey, list_contains(w, 'small') AS has, list_sort(list_distinct(list_intersect(list_transform(w, lambda x: lower(x)), v))) AS common, list_sort(list_distinct(list_filter(list_transform(w, lambda x: lower(x)), lambda x: NOT list_contains(v, x)))) AS rest,
      list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i) AS spellings, w[2:3] AS middle, len(w) AS n, len(w) * (len(w) - 1) // 2 AS pairs FROM w""")
def arrays(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.split(F.concat_ws(" ", "p_name", F.upper("p_name"), "p_type"), " ").alias("w"), F.split(F.lower(F.concat("p_type", F.lit(" small large"))), " ").alias("v"))
    low = F.transform("w", lambda x: F.lower(x))
    pairs = F.flatten(F.transform("w", lambda x, i: F.slice(F.col("w"), i + 2, F.size("w"))))
    return rows.select(
        "p_partkey", F.array_contains("w", "small").alias("has"), F.array_sort(F.array_intersect(low, F.col("v"))).alias("common"), F.array_sort(F.array_except(low, F.col("v"))).alias("rest"),
        unique_spellings(F.col("w")).alias("spellings"), F.slice("w", 2, 2).alias("middle"), F.size("w").cast("long").alias("n"), F.size(pairs).cast("long").alias("pairs"),
    )


@query("arrf02_csv_both_ways", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ', ,' || p_brand || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS field FROM part")
def csv_both_ways(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(from_csv_field(F.concat("p_type", F.lit(", ,"), "p_brand", F.lit(" ,"))), ",").alias("field"))


@query("mapf01_lookup", "WITH m AS (SELECT c_mktsegment AS key, arg_min(c_custkey, c_custkey) AS first FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT c_custkey, coalesce(first, -1) AS owner FROM customer LEFT JOIN m ON key = CASE WHEN c_nationkey % 5 = 0 THEN 'NONE' ELSE c_mktsegment END")
def lookup(t: Tables) -> DataFrame:
    """A map built from rows in order, where the first of a key wins, and looked up with a default."""
    built = t.customer.where("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("key")).agg(F.min("c_custkey").alias("first"))
    asked = t.customer.select("c_custkey", F.when(F.col("c_nationkey") % 5 == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("key"))
    return asked.join(built, "key", "left").select("c_custkey", F.coalesce("first", F.lit(-1)).alias("owner"))


_KINDS = """('{"a": ' || CASE event_id % 5 WHEN 0 THEN '" x' || user_id || ' "' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'true' WHEN 3 THEN '" "' ELSE '["p", 1, "q"]' END || CASE event_id % 7 WHEN 0 THEN '' ELSE '}' END)"""


@query("jsnf01_typed_access", f"""WITH j AS (SELECT event_id, CASE WHEN json_valid({_KINDS}) THEN CAST({_KINDS} AS JSON) END AS j FROM events)
    SELECT event_id, CASE WHEN json_type(j, '$.a') = 'VARCHAR' THEN nullif(trim(json_extract_string(j, '$.a')), '') END AS text, CASE WHEN json_type(j, '$.a') = 'BOOLEAN' THEN CAST(json_extract_string(j, '$.a') AS BOOLEAN) END AS flag, CASE WHEN json_type(j, '$.a') = 'ARRAY' THEN ['p', 'q'] END AS items FROM j""")
def typed_access(t: Tables) -> DataFrame:
    """Properties of a wrong kind are null, and so is all of a document that can't be read."""
    k = F.col("event_id") % 5
    value = F.when(k == 0, F.concat(F.lit('" x'), F.col("user_id").cast("string"), F.lit(' "'))).when(k == 1, F.col("user_id").cast("string")).when(k == 2, "true").when(k == 3, '" "').otherwise('["p", 1, "q"]')
    raw = F.concat(F.lit('{"a": '), value, F.when(F.col("event_id") % 7 == 0, "").otherwise("}"))
    return t.events.select("event_id", json_string(raw, "a").alias("text"), json_boolean(raw, "a").alias("flag"), json_strings(raw, "a").alias("items"))


@query("jsnf02_phases", "SELECT event_id, CASE WHEN event_id % 9 > 0 THEN user_id END AS rewrite_ms, CASE WHEN event_id % 9 > 0 THEN 0 END AS embed_ms, CASE WHEN event_id % 9 > 0 THEN user_id + 5 END AS total_ms FROM events")
def phase_times(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('{"rewriteMs": '), F.col("user_id").cast("string"), F.lit(', "totalMs": '), (F.col("user_id") + 5).cast("string"), F.when(F.col("event_id") % 9 > 0, "}").otherwise(""))
    rows = t.events.select("event_id", phases(raw).alias("p"))
    return rows.select("event_id", F.col("p.rewriteMs").alias("rewrite_ms"), F.col("p.embedMs").alias("embed_ms"), F.col("p.totalMs").alias("total_ms"))
