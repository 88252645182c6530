"""Passages of texts as evidence: sentence-aware chunks, defining sentences of terms, gates on what a text says of a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.texts import literal
from ..registry import Tables, query

# ---- chunks that end at sentences ----


def sentence_chunks(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """The chunks of a text (array<string>): white space is squeezed, a chunk has ``size`` characters at most, ends after the last full stop
    that a space follows if that lies past its half, and the next one begins ``overlap`` characters before its end.

    A fold that carries where the chunk begins and the text from there on; a null or blank text has no chunk.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    steps = F.sequence(F.lit(1), (F.length(clean) / (size // 2 - overlap)).cast("int") + 1)

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        window = F.left(rest, F.lit(size + 2))
        back = F.instr(F.reverse(window), " .")  # from the end
        dot = F.length(window) - back - 1
        end = F.when(F.length(rest) <= size, F.length(rest)).when((back > 0) & (dot > size * 0.5), dot + 1).otherwise(size)
        done = end >= F.length(rest)
        following = F.struct(F.array_append(acc["chunks"], F.trim(F.left(rest, end))).alias("chunks"), F.when(done, "").otherwise(F.substring(rest, end - overlap + 1, F.length(rest))).alias("rest"))
        return F.when(rest == "", acc).otherwise(following)

    start = F.struct(F.array().cast("array<string>").alias("chunks"), clean.alias("rest"))
    return F.filter(F.aggregate(steps, start, step, lambda acc: acc["chunks"]), lambda c: c != "")


@query(
    "txt02_sentence_chunks",
    r"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
    d AS (SELECT doc_id, 0 AS chunk, x AS rest, CAST(NULL AS VARCHAR) AS body FROM t WHERE x <> ''
      UNION ALL SELECT doc_id, chunk + 1, CASE WHEN e >= length(rest) THEN '' ELSE substr(rest, CAST(e - 120 + 1 AS INT)) END, trim(left(rest, CAST(e AS INT)))
      FROM (SELECT *, CASE WHEN length(rest) <= 900 THEN length(rest) WHEN p > 0 AND length(w) - p - 1 > 450 THEN length(w) - p ELSE 900 END AS e FROM (SELECT *, left(rest, 902) AS w, instr(reverse(left(rest, 902)), ' .') AS p FROM d WHERE rest <> '')))
    SELECT doc_id, chunk - 1 AS chunk, body FROM d WHERE chunk > 0""",
)
def chunked(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(sentence_chunks(F.col("text"))).alias("chunk", "body"))


# ---- definitions ----

#: What may follow a term that is defined: a number or a place-holder, then a mark or a copula (fixed values).
DEFINES = r"^\s*(?:\d+|[NXnx](?![\p{L}\p{Nd}]))?\s*(?:[:—–-]|(?:[iI][sS]|[aA][rR][eE])(?![\p{L}\p{Nd}]))"
#: Where sentences end: after a mark and white space, and at line ends.
SENTENCE_ENDS = r"(?<=[.!?])\s+|\n"


def sentence_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, sentence): the sentences of each text, trimmed, by place from 0; blank ones are left out."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), SENTENCE_ENDS)).alias("place", "sentence"))
    return rows.withColumn("sentence", F.trim(F.regexp_replace("sentence", r"\s+", " "))).where("sentence <> ''")


def definitions(terms: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, place, definition): the shortest sentence that defines each of ``terms`` (term), the first one of the shortest by key and place.

    A sentence defines what it begins with, in any case, if the term ends there as a word and a definition mark follows. A posting of
    a sentence is its first words, for each number of words that a term has, so terms and sentences meet by equality. A term has to
    end with a letter or digit; blank terms have no definition.
    """
    known = scratch.materialize(terms.select("term", F.lower(F.trim(F.regexp_replace("term", r"\s+", " "))).alias("_k")).where("_k <> ''").distinct(), "terms")
    lengths = sorted(r[0] for r in known.select(F.size(F.split("_k", " "))).distinct().collect())  # one row for each number of words
    if not lengths:
        return known.crossJoin(sentences.limit(0)).select("term", key, "place", F.col("sentence").alias("definition"))
    # The last word may hold marks of its own: its shortest and its longest reading.
    heads = F.array(*(F.regexp_extract("sentence", rf"^((?:\S+ ){{{n - 1}}}\S*{lazy}[\p{{L}}\p{{Nd}}])(?![\p{{L}}\p{{Nd}}])", 1) for n in lengths for lazy in ("?", "")))
    postings = sentences.select(key, "place", "sentence", F.explode(F.array_distinct(heads)).alias("head")).where("head <> ''")
    postings = postings.where(F.substring("sentence", F.length("head") + 1, F.length("sentence")).rlike(DEFINES))
    met = postings.join(scratch.maybe_broadcast(known), F.lower("head") == F.col("_k"))
    best = met.groupBy("term").agg(F.min(F.struct(F.length("sentence").alias("chars"), F.col(key), F.col("place"), F.col("sentence").alias("definition"))).alias("b"))
    return best.select("term", f"b.{key}", "b.place", "b.definition")


_SENTENCES = r"s AS (SELECT doc_id, i - 1 AS place, trim(regexp_replace(p[i], '\s+', ' ', 'g')) AS sentence FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', E'\\1\n', 'g'), '\n') AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i))"


@query(
    "txt08_definitions",
    rf"""WITH {_SENTENCES}, k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}'))) AS term FROM benchmark),
    h AS (SELECT *, regexp_extract(sentence, '^(\S*?[\pL\p{{Nd}}])([^\pL\p{{Nd}}]|$)', 1) AS head FROM s WHERE sentence <> '')
    SELECT term, arg_min(sentence, (length(sentence), doc_id, place)) AS definition, arg_min(doc_id, (length(sentence), doc_id, place)) AS doc_id
    FROM h JOIN k ON lower(head) = term WHERE head <> '' AND regexp_matches(substr(sentence, length(head) + 1), '^\s*(?:\d+|[NXnx](?:[^\pL\p{{Nd}}]|$))?\s*(?:[:—–-]|(?:[iI][sS]|[aA][rR][eE])(?:[^\pL\p{{Nd}}]|$))') GROUP BY term""",
)
def term_definitions(t: Tables) -> DataFrame:
    """What the documents say that words of the benchmark are."""
    terms = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"))).alias("term")).select(F.lower("term").alias("term"))
    return definitions(terms, sentence_index(t.documents)).select("term", "definition", "doc_id")


# ---- evidence ----

#: The words that a claim of each kind needs in its evidence.
ANCHORS = {
    "grants": ["grant", "grants", "granted", "give", "gives", "given", "has", "have"],
    "counters": ["counter", "counters", "countered", "can't", "can’t", "cannot", "prevent", "prevents", "prevented", "negate", "negates", "negated", "instead", "lose", "loses", "remove", "removes", "removed", "reduce", "reduces", "reduced", "ignore", "ignores", "ignored", "stop", "stops", "block", "blocks"],
    "modifies": ["modify", "modifies", "modified", "instead", "additional", "as though", "treat", "treats", "treated", "rather than", "replace", "replaces", "replaced"],
    "requires": ["require", "requires", "required", "need", "needs", "needed", "must", "only if", "in order", "as long as", "cost", "costs", "pay", "pays", "paid", "spend", "spends", "spent"],
}
#: Words that take a requirement back, and keywords that are verbs too, so that only brackets show them.
UNDERMINERS, VERB_LIKE = ["may", "optional", "optionally"], ["ready", "recycle"]
_QUOTES = "\"'“”‘’"
#: Spaces and quotes before a word that are looked back over at once; longer gaps take a slower pattern.
GAP = 40


def any_word(words: list[str]) -> str:
    """A pattern that finds any of ``words`` with no letter or digit next to it, in any case."""
    return r"(?iu)(?<![\p{L}\p{Nd}])(?:" + "|".join(words) + r")(?![\p{L}\p{Nd}])"


def sentence_gates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a column for each kind of ``ANCHORS``, clean_requires): whether a sentence of the text has a word of the kind, and one that requires
    without taking it back. Sentences are put together map-side."""
    rows = docs.select(key, F.explode(F.split(F.col(text), "[.!?]")).alias("s"))
    has = {kind: F.coalesce(F.col("s").rlike(any_word(words)), F.lit(False)) for kind, words in ANCHORS.items()}
    clean = has["requires"] & ~F.col("s").rlike(any_word(UNDERMINERS))
    return rows.groupBy(key).agg(*(F.max(c).alias(kind) for kind, c in has.items()), F.max(clean).alias("clean_requires"))


def word_forms(text: Column, label: Column) -> tuple[Column, Column]:
    """Whether ``label`` stands in ``text`` as a keyword (in brackets, or with a capital inside a sentence), and whether in brackets."""
    name = literal(F.trim(label))
    bracketed = F.rlike(text, F.concat(F.lit(r"(?iu)\["), name, F.lit(r"(?![\p{L}\p{Nd}])")))
    before = rf"(?:[^\s{_QUOTES}.!?][\s{_QUOTES}]+|[^\s{_QUOTES}.!?\p{{L}}\p{{Nd}}])"
    slow = F.rlike(text, F.concat(F.lit(before + r"(?=\p{Lu})(?iu:"), name, F.lit(r")(?![\p{L}\p{Nd}])")))
    # The same from the capital on, looking back only where the label stands. A look back sees no longer gaps and no pairs of surrogates: texts with these go the other way.
    near = rf"(?:(?<=[^\s{_QUOTES}.!?\p{{L}}\p{{Nd}}])|(?<=[^\s{_QUOTES}.!?][\s{_QUOTES}]{{1,{GAP}}}))"
    fast = F.rlike(text, F.concat(F.lit(r"(?=\p{Lu})(?=(?iu:"), name, F.lit(r")(?![\p{L}\p{Nd}]))" + near)))
    capital = F.when(F.rlike(text, F.lit(rf"[\s{_QUOTES}]{{{GAP + 1}}}|[\x{{10000}}-\x{{10FFFF}}]")), slow).otherwise(fast)
    given = F.trim(label) != ""
    bracketed = F.coalesce(given & bracketed, F.lit(False))
    return bracketed | F.coalesce(given & capital & ~F.lower(F.trim(label)).isin(VERB_LIKE), F.lit(False)), bracketed


def evidence_gates(claims: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``claims`` (key, label) with the gates of their text: word_form, bracketed, a column for each kind, clean_requires. Claims
    on a text that isn't there, or is null, pass none."""
    told = claims.join(docs.select(key, F.col(text).alias("_text")), key, "left").join(sentence_gates(docs, key, text), key, "left")
    form, bracketed = word_forms(F.col("_text"), F.col("label"))
    flags = [F.coalesce(kind, F.lit(False)).alias(kind) for kind in (*ANCHORS, "clean_requires")]
    return told.select(*claims.columns, form.alias("word_form"), bracketed.alias("bracketed"), *flags)


def _sql_word(words: list[str]) -> str:
    return r"(?i)(^|[^\pL\p{Nd}])(" + "|".join(w.replace("'", "''") for w in words) + r")([^\pL\p{Nd}]|$)"


_BEFORE = rf"(?:[^\s{_QUOTES}.!?][\s{_QUOTES}]+|[^\s{_QUOTES}.!?\pL\p{{Nd}}])".replace("'", "''")


@query(
    "txt09_gates",
    rf"""WITH c AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '[A-Z][a-z]{{7,}}')) AS label FROM documents),
    g AS (SELECT doc_id, {', '.join(f"bool_or(regexp_matches(s, '{_sql_word(words)}')) AS {kind}" for kind, words in ANCHORS.items())},
      bool_or(regexp_matches(s, '{_sql_word(ANCHORS["requires"])}') AND NOT regexp_matches(s, '{_sql_word(UNDERMINERS)}')) AS clean_requires FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?]')) AS s FROM documents) GROUP BY doc_id)
    SELECT c.doc_id, label, regexp_matches(text, '(?i)\[' || label || '([^\pL\p{{Nd}}]|$)') OR regexp_matches(text, '{_BEFORE}' || left(label, 1) || '(?i:' || substr(label, 2) || ')([^\pL\p{{Nd}}]|$)') AS word_form,
      regexp_matches(text, '(?i)\[' || label || '([^\pL\p{{Nd}}]|$)') AS bracketed, {', '.join(ANCHORS)}, clean_requires FROM c JOIN g USING (doc_id)""",
)
def gates(t: Tables) -> DataFrame:
    """Every longer capitalised word of a document as a claim on it."""
    claims = t.documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{7,})")))).alias("label"))
    return evidence_gates(claims, t.documents)


# ---- terms in context ----


def contexts(docs: DataFrame, terms: DataFrame, width: int = 60, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, term, snippet): every place where one of ``terms`` (term, single words) stands in a text as a word, in any case, with ``width`` characters on
    either side and dots where the text goes on; places are numbered from 0 in each text.

    Words meet the terms by equality first; a text is then read once, for the terms that it has.
    """
    known = terms.select(F.lower(F.trim("term")).alias("w")).where("w <> ''").distinct()
    words = docs.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")).alias("w")).join(scratch.maybe_broadcast(scratch.materialize(known, "terms")), "w")
    asked = words.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(literal(F.col("w")))), "|").alias("_any"))
    # The letter beyond 16 bits in the look back makes Java read whole pairs of surrogates there.
    pattern = F.concat(F.lit("(?iu)(?<![\\p{L}\\p{Nd}\U00010000])(?:"), "_any", F.lit(r")(?![\p{L}\p{Nd}])"))
    rows = docs.select(key, F.col(text).alias("_text")).join(asked, key).withColumn("_p", pattern)
    # A text is its hits and the parts between them. Two hits have a character between them, so no side reaches over more than this number of hits.
    near = width // 2 + 2
    rows = rows.select(key, F.split("_text", F.col("_p")).alias("parts"), F.regexp_extract_all("_text", F.col("_p"), F.lit(0)).alias("hits"))
    rows = rows.select(key, "hits", F.transform("parts", lambda x: F.right(x, F.lit(width + 1))).alias("ends"), F.transform("parts", lambda x: F.left(x, F.lit(width + 1))).alias("heads"))

    def around(hit: Column, at: Column) -> Column:
        first, n = F.greatest(at - near, F.lit(0)) + 1, F.least(at, F.lit(near))
        earlier = F.zip_with(F.slice("ends", first, n), F.slice("hits", first, n), lambda e, h: F.concat(e, h))
        later = F.zip_with(F.slice("hits", at + 2, F.lit(near)), F.slice("heads", at + 3, F.lit(near)), lambda h, s: F.concat(h, s))
        before = F.right(F.concat(F.array_join(earlier, ""), F.get("ends", at)), F.lit(width + 1))
        behind = F.left(F.concat(F.get("heads", at + 1), F.array_join(later, "")), F.lit(width + 1))
        return F.struct(before.alias("a"), hit.alias("b"), behind.alias("c"))

    hits = rows.select(key, F.posexplode(F.transform("hits", around)).alias("place", "h"))
    more = lambda c: F.length(c) > width
    before = F.when(more("h.a"), F.concat(F.lit("…"), F.right("h.a", F.lit(width)))).otherwise(F.col("h.a"))
    behind = F.when(more("h.c"), F.concat(F.left("h.c", F.lit(width)), F.lit("…"))).otherwise(F.col("h.c"))
    return hits.select(key, "place", F.lower("h.b").alias("term"), F.concat(before, F.col("h.b"), behind).alias("snippet"))


@query(
    "txt07_all_contexts",
    r"""WITH k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{10,}'))) AS w FROM benchmark),
    p AS (SELECT doc_id, text, i, x[i] AS piece FROM (SELECT doc_id, text, regexp_extract_all(text, '[\pL\p{Nd}]+|[^\pL\p{Nd}]+') AS x FROM documents), unnest(range(1, len(x) + 1)) AS u(i)),
    o AS (SELECT doc_id, text, i, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM p), h AS (SELECT *, stop - length(piece) AS start FROM o WHERE lower(piece) IN (SELECT w FROM k))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place, lower(piece) AS term, CASE WHEN start > 60 THEN '…' ELSE '' END || substr(text, greatest(1, start - 59), least(start, 60)) || piece || substr(text, stop + 1, 60) || CASE WHEN length(text) > stop + 60 THEN '…' ELSE '' END AS snippet FROM h""",
)
def all_contexts(t: Tables) -> DataFrame:
    """Long words of the benchmark wherever documents have them."""
    terms = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{10,})"))).alias("term"))
    return contexts(t.documents, terms)


# ---- keywords ----

#: What a bracketed keyword looks like once the number at its end is gone, and how long it is (fixed values).
KEYWORD_SHAPE, KEYWORD_CHARS = r"^\p{L}[\p{L} '’-]*$", (3, 30)


def keywords(docs: DataFrame, vocabulary: DataFrame, rejected: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, kind): the keywords of each text, each once in small letters. ``bracketed`` ones stand in square brackets, without the number at their
    end, if they have the shape and length of a keyword; ``candidate`` ones are phrases of ``vocabulary`` (term) that stand outside of brackets, word by
    word, and are not bracketed as well. Terms of ``rejected`` (term) are left out. Phrases of each number of words meet the vocabulary by equality.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", " "))
    bracket = r"\[([^\[\]]+)\]"
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(bracket), F.lit(1))).alias("t"))
    found = found.withColumn("t", F.trim(F.regexp_replace(F.trim("t"), r"\s*\d+$", ""))).where(F.col("t").rlike(KEYWORD_SHAPE) & F.length("t").between(*KEYWORD_CHARS))
    bracketed = found.select(key, F.lower("t").alias("term")).distinct()
    known = vocabulary.select(clean(F.col("term")).alias("term")).where("term <> ''").distinct()
    known = scratch.materialize(known.join(rejected.select(clean(F.col("term")).alias("term")), "term", "left_anti"), "vocabulary")
    lengths = sorted(r[0] for r in known.select(F.size(F.split("term", " "))).distinct().collect())  # one row for each number of words
    words = docs.select(key, F.filter(F.split(F.lower(F.regexp_replace(text, bracket, " ")), r"[^\p{L}\p{Nd}]+"), lambda w: w != "").alias("w"))
    starts = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: i)
    phrases = F.flatten(F.array(*(F.array_distinct(F.transform(F.filter(starts, lambda i: i + (n - 1) <= F.size("w")), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))) for n in lengths)))
    told = words.where("size(w) > 0").select(key, F.explode(phrases).alias("term")) if lengths else words.select(key, F.lit("").alias("term")).limit(0)
    candidates = told.join(scratch.maybe_broadcast(known), "term", "left_semi").select(key, "term").join(bracketed, [key, "term"], "left_anti").distinct()
    kept = bracketed.join(rejected.select(F.lower(F.trim("term")).alias("term")), "term", "left_anti").select(key, "term", F.lit("bracketed").alias("kind"))
    return kept.unionByName(candidates.select(key, "term", F.lit("candidate").alias("kind")))


@query(
    "txt05_vocabulary_keywords",
    r"""WITH v AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(lower(text), '[a-z]{10,}'), regexp_extract_all(lower(text), '[a-z]{4,} [a-z]{4,}'))) AS term FROM benchmark), r AS (SELECT DISTINCT term FROM v WHERE length(term) = 12),
    d AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN regexp_replace(text, '([A-Z][a-z]{4,})', '[\1 2]') ELSE text END AS text FROM documents),
    b AS (SELECT DISTINCT doc_id, lower(t) AS term FROM (SELECT doc_id, trim(regexp_replace(trim(unnest(regexp_extract_all(text, '\[([^\[\]]+)\]', 1))), '\s*\d+$', '')) AS t FROM d) WHERE regexp_matches(t, '^\pL[\pL ''’-]*$') AND length(t) BETWEEN 3 AND 30),
    w AS (SELECT doc_id, list_filter(string_split_regex(lower(regexp_replace(text, '\[([^\[\]]+)\]', ' ', 'g')), '[^\pL\p{Nd}]+'), lambda x: x <> '') AS w FROM d),
    p AS (SELECT DISTINCT doc_id, w[i] AS term FROM w, unnest(range(1, len(w) + 1)) AS u(i) UNION SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] FROM w, unnest(range(1, len(w))) AS u(i))
    SELECT doc_id, term, 'bracketed' AS kind FROM b WHERE term NOT IN (SELECT term FROM r)
    UNION ALL SELECT doc_id, term, 'candidate' FROM p WHERE term IN (SELECT term FROM v) AND term NOT IN (SELECT term FROM r) AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.term = p.term)""",
)
def vocabulary_keywords(t: Tables) -> DataFrame:
    """Long words and pairs of words of the benchmark as vocabulary; in a third of the documents the first capitalised word stands in brackets with a number."""
    terms = t.benchmark.select(F.explode(F.concat(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{10,})")), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,} [a-z]{4,})")))).alias("term")).distinct()
    first = F.regexp_extract("text", "([A-Z][a-z]{4,})", 1)
    at = F.locate("\0", F.regexp_replace("text", "^(?s)(.*?)[A-Z][a-z]{4,}", "$1\0"))
    marked = F.concat(F.substring("text", F.lit(1), at - 1), F.lit("["), first, F.lit(" 2]"), F.substring("text", at + F.length(first), F.length("text")))
    docs = t.documents.select("doc_id", F.when((F.col("n_chars") % 3 == 0) & (first != ""), marked).otherwise(F.col("text")).alias("text"))
    return keywords(docs, terms, terms.where(F.length("term") == 12))
