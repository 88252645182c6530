"""Chunks, definitions and evidence gates on small texts."""

import random
import re
import time

from pyspark.sql import functions as F

from marginalia.functions.texts import contains_word
from marginalia.operators import passages


def brute_chunks(text, size, overlap):
    clean = " ".join((text or "").split())
    out, i = [], 0
    while i < len(clean):
        end = min(i + size, len(clean))
        if end < len(clean):
            dot = clean.rfind(". ", 0, end + 2)
            if dot > i + size * 0.5:
                end = dot + 1
        out.append(clean[i:end].strip())
        if end >= len(clean):
            break
        i = end - overlap
    return [c for c in out if c]


def test_chunks_end_at_sentences_and_overlap(spark):
    r = random.Random(3)
    rows = [(None,), ("",), (" \n ",), ("a" * 100,), ("a" * 101,), ("x" * 5000,), ("x" * 60 + ". " + "y" * 39 + ". z",), (". " * 300,)]
    rows += [("".join(r.choice(["word ", "é ", ". ", "end. ", "\n", "long" * 20]) for _ in range(r.randrange(400))),) for _ in range(60)]
    got = spark.createDataFrame(rows, "text string").select("text", passages.sentence_chunks(F.col("text"), 100, 20).alias("c")).collect()
    assert len(got) == len(rows) and all(x.c == brute_chunks(x.text, 100, 20) for x in got)


def test_definitions_need_the_whole_term_and_a_mark(spark):
    docs = spark.createDataFrame(
        [(1, "Deflect: prevents one attack. Deflection is not it.\nTank N — holds N."), (2, "deflect is short. Ready units can be used."), (3, "Reaction Window: a moment.\nReaction is fast."), (4, None), (5, "Well-known is a term. well - first"), (6, "Tank 2: x. Deflect"), (7, "DEFLECT are many")],
        "doc_id long, text string",
    )
    terms = spark.createDataFrame([(x,) for x in ("Deflect", "Tank", "Ready", "reaction", "Reaction  Window", "well-known", "well", " ", None, "absent")], "term string")
    got = {r.term: (r.doc_id, r.place, r.definition) for r in passages.definitions(terms, passages.sentence_index(docs)).collect()}
    assert got == {"Deflect": (7, 0, "DEFLECT are many"), "Tank": (6, 0, "Tank 2: x."), "reaction": (3, 1, "Reaction is fast."), "Reaction  Window": (3, 0, "Reaction Window: a moment."), "well-known": (5, 0, "Well-known is a term."), "well": (5, 1, "well - first")}
    assert passages.definitions(terms.where("false"), passages.sentence_index(docs)).collect() == []


def test_gates(spark):
    rows = [(1, "Pay 2: give a unit [Shield]. You may spend one."), (2, "You may pay 2. Then Shield a unit"), (3, "Shield it. A “Shield” and shields."), (4, "It has (Shield) now!"), (5, "An [ready] unit must rest. Use Ready now."), (6, "Unshielded; needless payment"), (7, None), (8, "You can’t block a.b+c (now) [A.b+c]")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    claims = spark.createDataFrame([(k, "shield") for k in (1, 2, 3, 4, 6, 7, 9)] + [(5, "Ready"), (8, "a.b+c"), (8, ""), (8, None), (8, r"a\E(b")], "doc_id long, label string")
    got = {(r.doc_id, r.label): r for r in passages.evidence_gates(claims, docs).collect()}
    told = lambda k, label, *names: tuple(got[k, label][n] for n in names)
    assert [told(k, "shield", "word_form", "bracketed") for k in (1, 2, 3, 4, 6, 7, 9)] == [(True, True), (True, False), (True, False), (True, False), (False, False), (False, False), (False, False)]
    assert told(5, "Ready", "word_form", "bracketed") == (True, True) and told(8, "a.b+c", "word_form", "bracketed") == (True, True)
    assert [told(k, "shield", "grants", "requires", "clean_requires") for k in (1, 2, 4, 6)] == [(True, True, True), (False, True, False), (True, False, False), (False, False, False)]
    assert told(8, "", "word_form", "counters", "modifies") == (False, True, False) and told(8, None, "word_form") == (False,)


def test_terms_with_pattern_marks_are_found_as_they_stand(spark):
    rows = [(r"x a\E(b y", r"a\E(b"), ("a.b", "a.b"), ("axb", "a.b"), ("a$1 [z]", "$1 [z]"), ("a{2}", "a{2}"), ("(q", "q")]
    got = [r[0] for r in spark.createDataFrame(rows, "text string, term string").select(contains_word(F.col("text"), F.col("term"))).collect()]
    assert got == [True, True, False, False, True, True]


def test_keywords_are_bracketed_or_of_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "[Deflect 2] then Deflect, [deflect] and [Level up 11], leveling; level up."), (2, "Level Up! quick strike [x] [12] [no_shape] [Banned 3]"), (3, None), (4, ""), (5, "quick, strike banned [quick strike]")], "doc_id long, text string")
    terms = spark.createDataFrame([("Deflect",), ("level up",), ("Quick-Strike",), ("banned",), (" ",), (None,), ("level",)], "term string")
    got = {tuple(r) for r in passages.keywords(docs, terms, spark.createDataFrame([("Banned",), ("level",)], "term string")).collect()}
    assert got == {(1, "deflect", "bracketed"), (1, "level up", "bracketed"), (2, "level up", "candidate"), (2, "quick strike", "candidate"), (5, "quick strike", "bracketed")}


def test_contexts_find_hits_that_lie_near_each_other(spark):
    docs = spark.createDataFrame([(1, "x" * 70 + " Term term-TERM terms " + "y" * 70), (2, "term"), (3, None), (4, "no hit")], "doc_id long, text string")
    got = sorted(map(tuple, passages.contexts(docs, spark.createDataFrame([("TERM",), ("",), (None,), ("absent",)], "term string"), 10).collect()))
    assert got == [(1, 0, "term", "…xxxxxxxxx Term term-TERM…"), (1, 1, "term", "…xxxx Term term-TERM term…"), (1, 2, "term", "…Term term-TERM terms yyy…"), (2, 0, "term", "term")]


def test_capitals_inside_sentences_are_found_from_the_capital_on(spark):
    r = random.Random(8)
    gap = passages.GAP
    pieces = ["Shield", "shield", "SHIELD", " ", "  ", "\n", "“", "'", ". ", "!", "x", "é", "7", ",", "(", "Shields", "\U0001d400", " " * gap, " " * (gap + 1), "a" + " " * (gap + 5)]
    rows = [("".join(r.choice(pieces) for _ in range(r.randrange(1, 9))), r.choice(["Shield", "shield", "Shield x"])) for _ in range(3000)] + [(None, "Shield"), ("a Shield", None)]
    quotes = passages._QUOTES
    old = rf"(?:[^\s{quotes}.!?][\s{quotes}]+|[^\s{quotes}.!?\p{{L}}\p{{Nd}}])(?=\p{{Lu}})(?iu:"
    df = spark.createDataFrame(rows, "text string, label string").withColumn("form", passages.word_forms(F.col("text"), F.col("label"))[0])
    df = df.withColumn("want", F.coalesce(F.rlike("text", F.concat(F.lit(old), passages.literal(F.trim("label")), F.lit(r")(?![\p{L}\p{Nd}])"))), F.lit(False)))
    got = [(x.text, x.label, x.form, x.want) for x in df.collect()]
    assert [g for g in got if g[2] != g[3]] == [] and sum(g[3] for g in got) > 100
    # A long text is read once from its capitals on: many labels on it are no burden.
    text = F.lit("word of no interest, and more. " * 4000)
    began = time.time()
    assert spark.range(0, 400, 1, 4).select(passages.word_forms(F.concat(text, F.col("id").cast("string")), F.lit("Shielded"))[0].alias("f")).where("f").count() == 0
    assert time.time() - began < 60


def test_contexts_of_many_hits_are_read_without_looking_back_at_each_character(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["Ab", "aB c", "\U0001d4aa", "x-", " ", " ", "\n", "é1", "(ab)", "q" * 30 + " "]) for _ in range(400)) for _ in range(6)] + ["ab", "ab ab", "", "nothing"]
    df = passages.contexts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([("ab",), ("é1",)], "term string"), 11)
    want = []
    for k, text in enumerate(texts):
        for place, m in enumerate(x for x in re.finditer(r"[^\W_]+", text) if x[0].lower() in ("ab", "é1")):
            a, b = m.span()
            want.append((k, place, m[0].lower(), ("…" if a > 11 else "") + text[max(0, a - 11) : b + 11] + ("…" if len(text) > b + 11 else "")))
    assert len(want) > 100 and sorted(map(tuple, df.collect())) == want
    assert "(?<=(" not in df._jdf.queryExecution().optimizedPlan().toString()
