"""Entity linking: mentions by the longest surface or by trigrams, candidates scored by four signals, resolution by three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.scalars import normal_form
from ..functions.texts import similarity, trigrams
from ..registry import Tables, query
from .retrieval import cosine_distance
from .windows import first_by

#: Tokens of a span, least likeness of a fuzzy mention and how many candidates it keeps, weights of the signals of a link and its least score.
SPAN, FUZZY, KEPT = 4, 0.55, 5
#: Words that a task holds against all surfaces.
WORDS = 1_000
WEIGHTS, LEAST = {"lexical": 0.30, "cosine": 0.25, "coherence": 0.35, "prior": 0.10}, 0.20
#: Fixed values of entity resolution: characters of a block, and when likeness and cosine count as strong.
BLOCK, ALIKE, CLOSE = 4, 0.45, 0.85


def tokens(text: Column) -> Column:
    """The words of a text without marks at either end."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.btrim(w, F.lit(".,?!;:\"'()[]"))), lambda w: w != "")


def _spans(lengths: Column) -> Column:
    """From the length of the longest surface at each place (0 for none) the places that are taken, left to right: (at, len), 0 for single tokens without a surface."""
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast("array<struct<at:int,len:int>>").alias("taken"))

    def step(s: Column, n: Column) -> Column:
        starts = s["at"] >= s["free"]
        taken = F.when(starts, F.array_append(s["taken"], F.struct(s["at"].alias("at"), n.alias("len")))).otherwise(s["taken"])
        return F.struct((s["at"] + 1).alias("at"), F.when(starts, s["at"] + F.greatest(n, F.lit(1))).otherwise(s["free"]).alias("free"), taken.alias("taken"))

    return F.aggregate(lengths, none, step, lambda s: s["taken"])


def mentions(texts: DataFrame, keys: list[str], text: str, surfaces: DataFrame) -> DataFrame:
    """(keys, at, len, form, ref, likeness): what ``texts`` mention of ``surfaces`` (form, ref; forms are normal).

    At each word the longest span of up to ``SPAN`` words that is a surface is taken, and the words go on after it. A word
    of three letters or more that no span takes is held against all surfaces by trigrams; the five most alike from
    ``FUZZY`` on are its candidates. Spans and trigrams find surfaces by joins, never one by one.
    """
    rows = texts.select(*keys, tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    forms = surfaces.select("form").distinct()
    grams = F.flatten(F.transform("w", lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(SPAN), F.size("w") - i)), lambda n: F.struct(i.alias("at"), n.alias("len"), normal_form(F.array_join(F.slice("w", i + 1, n), " ")).alias("form")))))
    hits = rows.select(*keys, F.inline(grams)).join(forms, "form").groupBy(*keys, "at").agg(F.max("len").alias("len"))
    longest = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "len"))).alias("m"))
    placed = rows.join(longest, keys, "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,int>")))
    lengths = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    taken = placed.select(*keys, "w", F.inline(_spans(lengths)))
    taken = taken.select(*keys, "at", F.greatest("len", F.lit(1)).alias("len"), (F.col("len") > 0).alias("exact"), normal_form(F.array_join(F.slice("w", F.col("at") + 1, F.greatest("len", F.lit(1))), " ")).alias("form"))
    exact = taken.where("exact").join(surfaces, "form").select(*keys, "at", "len", "form", "ref", F.lit(1.0).alias("likeness"))
    loose = taken.where(~F.col("exact") & (F.length("form") >= 3))
    words, known = (scratch.materialize(df.select("form").distinct().select("form", trigrams(F.col("form")).alias("g")).withColumn("id", F.monotonically_increasing_id()), "forms") for df in (loose, surfaces))
    # Each word is held against all surfaces where it is: a bounded number of words for each task.
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // WORDS))
    each = words.select("id", F.size("g").alias("n"), "g").repartition(tasks, "id").select("id", "n", F.explode("g").alias("t"))
    other = known.select(F.col("id").alias("s"), F.size("g").alias("m"), F.explode("g").alias("t"))
    alike = F.least("n", "m") >= (FUZZY - 1e-9) * F.greatest("n", "m")  # else they can't have enough trigrams in common
    near = each.join(scratch.maybe_broadcast(other), "t").where(alike).groupBy("id", "s").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    near = near.select("id", "s", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("likeness")).where(F.col("likeness") >= FUZZY)
    near = near.join(words.select("id", "form"), "id").join(known.select(F.col("id").alias("s"), F.col("form").alias("surface")), "s").select("form", "surface", "likeness")
    best = near.join(surfaces.withColumnRenamed("form", "surface"), "surface").groupBy("form", "ref").agg(F.max("likeness").alias("likeness"))
    best = first_by(best, ["form"], F.desc("likeness"), "ref", n=KEPT)
    return exact.unionByName(loose.join(best, "form").select(*keys, "at", "len", "form", "ref", "likeness"))


def linked(candidates: DataFrame, key: str, edges: DataFrame, cosines: DataFrame) -> DataFrame:
    """(key, form, ref, score): the best candidate of each mention by likeness, cosine, coherence and prior, null where none reaches ``LEAST``.

    ``candidates`` (key, form, ref, likeness, prior), ``edges`` (ref, other) both ways, ``cosines`` (key, ref, cosine).
    Coherence is the share of the other mentions of ``key`` with a candidate that an edge ties to this one.
    """
    c = candidates.distinct()
    tied = c.select(key, "form", "ref").join(edges, "ref").join(c.select(key, F.col("form").alias("form2"), F.col("ref").alias("other")).distinct(), [key, "other"]).where("form <> form2")
    hits = tied.groupBy(key, "form", "ref").agg(F.countDistinct("form2").alias("hits"))
    others = c.groupBy(key).agg((F.countDistinct("form") - 1).alias("others"))
    rows = c.join(others, key).join(hits, [key, "form", "ref"], "left").join(cosines, [key, "ref"], "left")
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))))
    coherence = F.when(F.col("others") == 0, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("others"))
    parts = {"lexical": clamp(F.col("likeness")), "cosine": clamp(F.col("cosine")), "coherence": coherence, "prior": clamp(F.col("prior"))}
    score = F.round(sum(WEIGHTS[n] * x for n, x in parts.items()), 9)
    best = first_by(rows.withColumn("score", score), [key, "form"], F.desc("score"), F.col("ref").cast("string"))
    return best.select(key, "form", F.when(F.col("score") >= LEAST, F.col("ref")).alias("ref"), "score")


def opening_surfaces(t: Tables) -> DataFrame:
    """(form, ref): the first one, two and three words of each benchmark item are the surfaces that name it."""
    words = tokens(F.col("text"))
    return t.benchmark.select(F.col("item_id").alias("ref"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: normal_form(F.array_join(F.slice(words, F.lit(1), n), " ")))).alias("form")).where("form <> ''").distinct()


@query("ent01_mentions")
def detected(t: Tables) -> DataFrame:
    found = mentions(t.conversations.where("text IS NOT NULL"), ["conv_id", "turn"], "text", opening_surfaces(t))
    return found.select("conv_id", "turn", "at", "len", "form", "ref", F.round("likeness", 9).alias("likeness"))


_WORDS = "(SELECT item_id AS ref, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS form FROM benchmark)"


@query("ent02_links", rf"""WITH w AS {_WORDS}, p AS (SELECT form, count(*) AS n FROM w GROUP BY 1), c AS (SELECT DISTINCT conv_id, form, ref, 1.0 / n AS prior FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS form FROM conversations) JOIN w USING (form) JOIN p USING (form)),
    e AS (SELECT DISTINCT a.ref, b.ref AS other FROM w a JOIN w b USING (form) WHERE length(form) >= 8 AND a.ref <> b.ref), h AS (SELECT c.conv_id, c.form, c.ref, count(DISTINCT d.form) AS hits FROM c JOIN e ON e.ref = c.ref JOIN c d ON d.conv_id = c.conv_id AND d.ref = e.other AND d.form <> c.form GROUP BY 1, 2, 3), o AS (SELECT conv_id, count(DISTINCT form) - 1 AS others FROM c GROUP BY 1),
    s AS (SELECT c.conv_id, c.form, c.ref, round(0.30 + 0.25 * least(1.0, greatest(0.0, coalesce(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))), 0))) + 0.35 * CASE WHEN others = 0 THEN 0 ELSE coalesce(hits, 0) / others END + 0.10 * prior, 9) AS score
      FROM c JOIN o USING (conv_id) LEFT JOIN h USING (conv_id, form, ref) LEFT JOIN embeddings x ON x.vec_id = c.conv_id LEFT JOIN embeddings y ON y.vec_id = c.ref)
    SELECT conv_id, form, ref, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, form ORDER BY score DESC, CAST(ref AS VARCHAR)) = 1""")
def links(t: Tables) -> DataFrame:
    """The items that words of a conversation stand for: vectors of both, ties between items by a shared long word, rarity of the word."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})")))).alias("form")
    w = t.benchmark.select(F.col("item_id").alias("ref"), words)
    prior = w.groupBy("form").agg((1.0 / F.count("*")).alias("prior"))
    c = t.conversations.select("conv_id", words).distinct().join(w, "form").join(prior, "form").withColumn("likeness", F.lit(1.0))
    tied = w.where(F.length("form") >= 8)
    e = tied.join(tied.select(F.col("ref").alias("other"), "form"), "form").where("ref <> other").select("ref", "other").distinct()
    x, y = (t.embeddings.select(F.col("vec_id").alias(k), F.col("embedding").alias(v)) for k, v in (("conv_id", "x"), ("ref", "y")))
    cosines = c.select("conv_id", "ref").distinct().join(x, "conv_id").join(y, "ref").select("conv_id", "ref", (1 - cosine_distance(F.col("x"), F.col("y"))).alias("cosine"))
    return linked(c, "conv_id", e, cosines).withColumn("score", F.round("score", 6))


@query("ent03_three_signals", f"""WITH n AS (SELECT lower(p_name) AS form, min(p_partkey) AS id FROM part GROUP BY 1), g AS (SELECT n.*, list_distinct(list_transform(range(1, length(form) + 2), lambda i: substr('  ' || form || ' ', i, 3))) AS g, CAST(embedding AS DOUBLE[]) AS e FROM n LEFT JOIN embeddings ON vec_id = id),
    p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= {ALIKE} AS alike, coalesce(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {CLOSE}, false) AS close FROM g a JOIN g b ON left(a.form, {BLOCK}) = left(b.form, {BLOCK}) AND a.id < b.id)
    SELECT a, b, 1 + alike::INT + close::INT AS signals, CASE WHEN alike AND close THEN 'auto' WHEN alike OR close THEN 'review' ELSE 'none' END AS verdict FROM p""")
def three_signals(t: Tables) -> DataFrame:
    """Names of one block held against each other by trigrams and by the vectors of their first rows: three signals merge, two are reviewed.

    Rows of one name are one entity, so the pairs of a block grow with the names, not with the rows.
    """
    names = t.part.groupBy(normal_form(F.col("p_name")).alias("form")).agg(F.min("p_partkey").alias("id"))
    g = names.join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("e")), "id", "left").select("id", F.left("form", F.lit(BLOCK)).alias("block"), trigrams(F.col("form")).alias("g"), "e")
    pairs = g.toDF("a", "block", "ga", "ea").join(g.toDF("b", "block", "gb", "eb"), "block").where("a < b")
    alike = similarity(F.col("ga"), F.col("gb")) >= ALIKE
    close = F.coalesce(1 - cosine_distance(F.col("ea"), F.col("eb")) >= CLOSE, F.lit(False))
    signals = 1 + alike.cast("int") + close.cast("int")
    return pairs.select("a", "b", signals.alias("signals"), F.when(signals == 3, "auto").when(signals == 2, "review").otherwise("none").alias("verdict"))
