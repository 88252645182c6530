"""Texts in parts: sections by their headers and codes, parents of a section, segments of a prompt, batches for an encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import parent_codes, section_code, stripped
from ..registry import Tables, query

#: The header of a section at the start of a line, the characters of a section, of an introduction, of a parent's preview.
HEADER, MOST, LEAST_INTRO, PREVIEW = r"^\s*(\d{1,4}(?:\.\d+)*(?:\.?[a-z])?)[.\s]\s*(?=\S)", 2400, 40, 300


def packed(body: Column, most: int) -> Column:
    """A text in parts of at most ``most`` characters, cut between sentences; a longer sentence is a part of its own."""
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        full = (F.length(state["open"]) + F.length(sentence) > most) & (F.length(state["open"]) > 0)
        done = F.when(full, F.array_append(state["done"], F.trim(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.concat(F.when(full, "").otherwise(state["open"]), sentence, F.lit(" ")).alias("open"))

    return F.aggregate(F.split(body, r"(?<=\.)\s+"), none, add, lambda s: F.array_append(s["done"], F.trim(s["open"])))


def parsed_sections(docs: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """(key, pos, part, code, body, page): the sections of each text. What stands before the first header is ``intro`` if it
    is long enough; a text without headers is one section without a code; pages are counted by form feeds."""
    pieces = docs.select(key, F.posexplode(F.split(F.col(text), rf"(?m)(?={HEADER})")).alias("pos", "piece"))
    by = Window.partitionBy(key).orderBy("pos")
    feeds = F.regexp_count("piece", F.lit("\f"))
    rows = pieces.select(key, "pos", "piece", (F.coalesce(F.sum(feeds).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int").alias("page"))
    rows = rows.withColumn("raw", F.regexp_extract("piece", HEADER, 1)).withColumn("headed", F.max(F.col("raw") != "").over(Window.partitionBy(key)))
    rows = rows.withColumn("body", F.trim(F.regexp_replace(F.regexp_replace("piece", HEADER, ""), r"\s+", " ")))
    code = F.when(F.col("raw") != "", section_code(F.col("raw"))).when(F.col("headed"), "intro").otherwise("")
    kept = rows.withColumn("code", code).where((F.col("body") != "") & ((F.col("code") != "intro") | (F.length("body") > LEAST_INTRO)))
    parts = F.when(F.length("body") <= most, F.array("body")).otherwise(packed(F.col("body"), most))
    return kept.select(key, "pos", "code", "page", F.posexplode(parts).alias("part", "body"))


def parents(chunks: DataFrame, source: str = "source") -> DataFrame:
    """(source, code, depth, parent, text): for each section of ``chunks`` (source, code, chunk_index, text) its parents that are
    present, the topmost first, with the opening of their first chunk."""
    opening = F.when(F.length("text") <= PREVIEW, F.col("text")).otherwise(F.concat(F.left("text", F.lit(PREVIEW)), F.lit("…")))
    first = chunks.groupBy(source, F.col("code").alias("parent")).agg(F.min_by(opening, "chunk_index").alias("text"))
    asked = chunks.select(source, "code").distinct().select(source, "code", F.posexplode(parent_codes(F.col("code"))).alias("depth", "parent"))
    return asked.join(first, [source, "parent"]).select(source, "code", "depth", "parent", "text")


def segments(text: Column, size: int = 12_000, most: int = 4) -> Column:
    """At most ``most`` segments of ``size`` characters, each cut at its last blank unless that lies before the middle; what is left after them is dropped, as the operator has it."""
    start = F.struct(F.array().cast("array<string>").alias("done"), stripped(text).alias("rest"))

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        back = F.locate(" ", F.reverse(F.left(rest, F.lit(size + 1))))
        cut = F.when((back == 0) | (size + 1 - back < size // 2), size).otherwise(size + 1 - back)
        last = F.length(rest) <= size
        piece = F.when(last, rest).otherwise(F.left(rest, cut))
        left = F.when(last, "").otherwise(F.regexp_replace(F.substring(rest, cut + 1, F.length(rest)), r"^\s+", ""))
        return F.struct(F.when(F.length(rest) > 0, F.array_append(state["done"], piece)).otherwise(state["done"]).alias("done"), left.alias("rest"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["done"])


def batches(lengths: Column, most_items: int, most_chars: int) -> Column:
    """The number of the batch of each item, in order: a batch ends before the item that would take it over either bound, and is never empty."""
    none = F.struct(F.array().cast("array<int>").alias("of"), F.lit(0).alias("items"), F.lit(0).alias("chars"), F.lit(1).alias("batch"))

    def add(s: Column, n: Column) -> Column:
        full = (s["items"] > 0) & ((s["items"] >= most_items) | (s["chars"] + n > most_chars))
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.array_append(s["of"], batch).alias("of"), F.when(full, 1).otherwise(s["items"] + 1).alias("items"), F.when(full, n).otherwise(s["chars"] + n).alias("chars"), batch.alias("batch"))

    return F.aggregate(lengths, none, add, lambda s: s["of"])


def headed_texts(t: Tables) -> DataFrame:
    """(doc_id, text): documents with a numbered header at every third line and a page break at every fifth."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 3 == 2, F.concat((i + 1).cast("string"), F.lit("."), (i % 7).cast("string"), F.lit("b. "))).otherwise(""), x, F.when(i % 5 == 4, "\f").otherwise("")))
    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("txt01_parsed_sections")
def parsed(t: Tables) -> DataFrame:
    return parsed_sections(headed_texts(t), "doc_id", "text").select("doc_id", "pos", "part", "code", "page", F.sha2("body", 256).alias("body_sha"))


_CHUNKS = "chunks AS (SELECT source, CASE WHEN i = 1 THEN CAST(doc_id AS VARCHAR) WHEN i % 3 = 0 THEN doc_id || '.' || i // 3 ELSE doc_id || '.' || i // 3 || '.' || i % 3 END AS code, doc_id * 10000 + i AS chunk_index, s[i] AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i))"


def coded_chunks(t: Tables) -> DataFrame:
    """(source, code, chunk_index, text): the lines of documents under codes of one to three parts."""
    rows = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "text")).withColumn("i", F.col("at") + 1)
    d, q, r = F.col("doc_id").cast("string"), F.floor(F.col("i") / 3).cast("string"), (F.col("i") % 3).cast("string")
    code = F.when(F.col("i") == 1, d).when(F.col("i") % 3 == 0, F.concat_ws(".", d, q)).otherwise(F.concat_ws(".", d, q, r))
    return rows.select("source", code.alias("code"), (F.col("doc_id") * 10_000 + F.col("i")).alias("chunk_index"), "text")


@query("rag04_parents", f"""WITH {_CHUNKS}, f AS (SELECT source, code AS parent, arg_min(CASE WHEN length(text) <= 300 THEN text ELSE left(text, 300) || '…' END, chunk_index) AS text FROM chunks GROUP BY 1, 2),
    a AS (SELECT source, code, u.depth, array_to_string(string_split(code, '.')[1:u.depth + 1], '.') AS parent FROM (SELECT DISTINCT source, code FROM chunks), unnest(range(0, len(string_split(code, '.')) - 1)) AS u(depth)) SELECT source, code, depth, parent, sha256(text) AS text_sha FROM a JOIN f USING (source, parent)""")
def parent_sections(t: Tables) -> DataFrame:
    return parents(coded_chunks(t)).select("source", "code", F.col("depth").cast("long").alias("depth"), "parent", F.sha2("text", 256).alias("text_sha"))


@query("txt03_segments", r"""WITH RECURSIVE s AS (SELECT doc_id, 0 AS k, '' AS piece, regexp_replace(text, '^\s+|\s+$', '', 'g') AS rest FROM documents UNION ALL
    SELECT doc_id, k + 1, CASE WHEN length(rest) <= 400 THEN rest ELSE left(rest, cut) END, CASE WHEN length(rest) <= 400 THEN '' ELSE regexp_replace(substr(rest, cut + 1), '^\s+', '') END
    FROM (SELECT *, CASE WHEN instr(reverse(left(rest, 401)), ' ') = 0 OR 401 - instr(reverse(left(rest, 401)), ' ') < 200 THEN 400 ELSE 401 - instr(reverse(left(rest, 401)), ' ') END AS cut FROM s) WHERE k < 4 AND length(rest) > 0)
    SELECT doc_id, k AS segment, length(piece) AS chars, sha256(piece) AS piece_sha FROM s WHERE k > 0""")
def prompt_segments(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(segments(F.col("text"), 400)).alias("at", "piece"))
    return rows.select("doc_id", (F.col("at") + 1).alias("segment"), F.length("piece").cast("long").alias("chars"), F.sha2("piece", 256).alias("piece_sha"))


@query("txt04_batches", """WITH RECURSIVE l AS (SELECT doc_id, i, least(length(s[i]), 300) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)),
    r AS (SELECT doc_id, i, 1 AS items, n AS chars, 1 AS batch FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, CASE WHEN items >= 8 OR chars + n > 1000 THEN 1 ELSE items + 1 END, CASE WHEN items >= 8 OR chars + n > 1000 THEN n ELSE chars + n END, CASE WHEN items >= 8 OR chars + n > 1000 THEN batch + 1 ELSE batch END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
    SELECT doc_id, batch, count(*) AS items, sum(n) AS chars FROM (SELECT r.doc_id, r.batch, l.n FROM r JOIN l USING (doc_id, i)) GROUP BY 1, 2""")
def encoder_batches(t: Tables) -> DataFrame:
    """Lines capped at 300 characters, in batches of at most 8 lines and 1,000 characters, in their order."""
    capped = t.documents.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.least(F.length(x), F.lit(300))).alias("n"))
    rows = capped.select("doc_id", F.explode(F.arrays_zip(batches(F.col("n"), 8, 1000).alias("batch"), F.col("n").alias("n"))).alias("x"))
    return rows.groupBy("doc_id", F.col("x.batch").alias("batch")).agg(F.count("*").alias("items"), F.sum("x.n").alias("chars"))


@query("join19_resolved_refs", r"WITH n AS (SELECT trim(regexp_replace(lower(w), '[\s_-]+', ' ', 'g')) AS form, min(item_id) AS item_id FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS w FROM benchmark) GROUP BY 1), c AS (SELECT DISTINCT conv_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS form FROM conversations) SELECT conv_id, form, item_id FROM c JOIN n USING (form)")
def resolved_refs(t: Tables) -> DataFrame:
    """Words resolved through a dictionary of normal forms, where the first owner of a form wins."""
    from ..functions.scalars import normal_form

    listed = t.benchmark.select("item_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{4,})"))).alias("w"))
    forms = listed.groupBy(normal_form(F.col("w")).alias("form")).agg(F.min("item_id").alias("item_id"))
    said = t.conversations.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"))).alias("w")).select("conv_id", F.lower("w").alias("form")).distinct()
    return said.join(forms, "form").select("conv_id", "form", "item_id")
