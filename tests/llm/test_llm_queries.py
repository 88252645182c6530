"""The registered queries against their SQL, or against a brute-force version of what they promise."""

import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import database, expected, rows_of
from marginalia.llm import bpe, chat, common, components, decontaminate, jaccard, langid, lines, quality, queries, sharding, suffixes, topk


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == expected(database(sf_dir), queries.ORACLES[name])


def brute_spans(docs, width=200):
    raw = {i: (t or "").encode() for i, t in docs}
    count = Counter(b[p : p + width] for b in raw.values() for p in range(len(b) - width + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [4096, 2])
def test_op1_removes_exactly_what_repeats(spark, sf_dir, docs, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    got = {r[0]: tuple(r)[1:] for r in suffixes.op1_suffix_dedup(spark, sf_dir).collect()}
    assert got == brute_spans(docs)


def test_op1_suffix_ranks_sort_prefixes():
    r = np.random.default_rng(1)
    for n, letters in ((1, 2), (5, 1), (40, 2), (999, 3), (3000, 4)):
        data = r.integers(0, letters, n).astype(np.uint8)
        data[n // 2 : n // 2 + n // 4] = data[: n // 4]
        raw, ranks = data.tobytes(), suffixes.suffix_ranks(data.astype(np.int64) + 1, 200)
        order = np.argsort(ranks, kind="stable")
        assert [raw[i : i + 200] for i in order] == sorted(raw[i : i + 200] for i in range(n))


def test_op1_blocks_take_two_crowded_anchors():
    r, n = np.random.default_rng(3), 4000
    raw = [x.tobytes() for x in r.integers(0, 256, (2 * n, 304), dtype=np.uint8)]
    raw[1] = raw[0][:250] + raw[1][250:]  # the first 51 windows of a stretch in another one of its anchor
    rows = [{"doc_id": k, "print": 0, "start": 0, "count": 105, "anchor": k // n, "whole": k, "alone": True, "bytes": b} for k, b in enumerate(raw)]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=1000)
    got = [tuple(x.values()) for b in suffixes._sorted_blocks("doc_id", 200)(iter(batches)) for x in b.to_pylist()]
    assert sorted(got) == [(0, 0, 0, 51), (1, 0, 0, 51)]
    assert all(suffixes._crowd(w) * (2 * w - suffixes.ANCHOR) <= suffixes.MOST_BYTES for w in (97, 200, 400, 5000))


def test_op1_cuts_long_texts_and_keeps_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 700)
    r = np.random.default_rng(2)
    text = "".join(chr(97 + x) for x in r.integers(0, 26, 5000))
    rows = [(1, text), (2, text[1000:1450] + "é" * 300), (3, None), (4, ""), (5, "x" * 900), (6, text[4000:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x[0]: tuple(x)[1:] for x in suffixes.repeated_spans(df).mapInArrow(suffixes._removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()}
    assert got == brute_spans(rows)


def brute_components(sets, num, den):
    ids, top = sorted(sets), {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in ids}


def word_sets(docs, n):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def test_op6_links_every_similar_pair(spark, sf_dir, docs):
    sets = word_sets(docs, 3)
    want = {i: (len(sets[i]), c) for i, c in brute_components(sets, 90, 100).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op6_ngram_jaccard(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_op6_groups_of_near_copies(spark, n, num):
    r = np.random.default_rng(4)
    rows = []
    for length in (2, 4, 9, 11, 12, 20, 40, 90, 200):
        base = [f"w{x}" for x in r.integers(0, 500, length)]
        for _ in range(16):
            w = list(base)
            for at in r.integers(0, length, r.integers(0, max(2, length // 15))):
                w[at] = f"x{r.integers(0, 3)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "A"), (903, "a"), (904, " \t\n")]
    sets = word_sets(rows, n)
    want = {i: (len(sets[i]), c) for i, c in brute_components(sets, num, 100).items()}
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, component_id int, prints int")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join(df, n, num, 100).collect()} == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, x) for x in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)}


def line_shingles(line):
    return {line[k : k + 12] for k in range(max(1, len(line) - 11))}


def brute_lines(docs):
    places = {}
    for i, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(lines.BLANKS):
                places.setdefault(line.strip(lines.BLANKS), []).append((i, k))
    names = list(places)
    groups = brute_components({k: line_shingles(x) for k, x in enumerate(names)}, 80, 100)
    first = {}
    for k, x in enumerate(names):
        first[groups[k]] = min(first.get(groups[k], (1 << 60, 0)), min(places[x]))
    keep = set(first.values())
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(lines.BLANKS) or (i, k) in keep) for i, t in docs}


def test_op3_keeps_one_line_of_each_component(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(12):
        words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(60)]
        for _ in range(4):
            w = list(words)
            w[r.integers(0, 60)] = "changed"
            rows.append((len(rows), " ".join(w) + "\n\nshared line of all texts \n" + str(k)))
    rows += [(90, None), (91, ""), (92, "\n"), (93, "shared line of all texts\nshared line of all texts"), (94, "漢字" * 400 + "\nwordswithoutblanks" * 30)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, drop int, n_lines int")
    assert {x.doc_id: x.text for x in lines.dedup(df).collect()} == brute_lines(rows)


def test_op3_links_unspaced_lines_with_an_early_insertion(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(6)
    url = lambda n: "".join("abcdefghijklmnopqrstuvwxyz0123456789/"[c] for c in r.integers(0, 37, n))
    a, b, c = url(250), "".join(chr(0x4E00 + x) for x in r.integers(0, 9000, 250)), url(250)
    rows = [(1, a), (2, a[:20] + "Z" + a[20:]), (3, b), (4, b[:20] + "字" + b[20:]), (5, c), (6, c[:200] + url(50)), (7, "short"), (8, "shorts")]
    got = {x.doc_id: x.text for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "" if i in (2, 4) else t for i, t in rows}
    told = [a, b, "short", "exactly 12 c", "one more a c\r", "aaaaaaaaaaaaaaaa", "é漢x"]
    row, prints = lines.shingles(*common.as_bytes(pa.array(told)))
    assert all((row == k).sum() == max(1, len(x) - 11) and len(set(prints[row == k].tolist())) == len(line_shingles(x)) for k, x in enumerate(told))


def test_op3_candidates_have_high_recall():
    """The share of pairs at the threshold that agree in a band, measured over sets of very different sizes."""
    r, found, pairs = np.random.default_rng(8), 0, 0
    for size in (9, 18, 45, 90, 360):
        own = max(1, size // 10)
        both = size - own
        for _ in range(400):
            text = lambda n: r.integers(97, 123, n + 11, dtype=np.uint8).tobytes()
            shared = text(both)
            x, y = (shared + r.integers(97, 123, own, dtype=np.uint8).tobytes() for _ in range(2))
            a, b = (set(p[k : k + 12] for k in range(len(p) - 11)) for p in (x, y))
            assert len(a & b) / len(a | b) > 0.6
            s = lines.signatures(*common.as_bytes(pa.array([x.decode(), y.decode()])))
            if len(a & b) * 100 >= 80 * len(a | b):
                found, pairs = found + bool((s[0] == s[1]).any()), pairs + 1
    assert pairs > 300 and found / pairs >= 0.99


def test_op3_query_gives_every_document(spark, sf_dir, docs):
    got = lines.op3_line_dedup(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    assert all(0 <= r.n_kept <= r.n_lines for r in got)


def test_op4_balances_bytes_and_numbers_slots(spark, sf_dir, docs):
    rows = sharding.op4_kd_shards(spark, sf_dir).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    for shard in range(8):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def check_kd(rows, spans, slack, low, high):
    """Every node is cut along its widest dimension, near the bytes that its leaves on the left should hold."""
    if high - low == 1:
        return
    width = lambda d: (max(r[d] for r in rows) - min(r[d] for r in rows)) / spans[d]
    widest, middle = max(range(3), key=lambda d: (width(d), -d)), low + (high - low) // 2
    left, right = [r for r in rows if r[3] < middle], [r for r in rows if r[3] >= middle]
    assert max(r[widest] for r in left) <= min(r[widest] for r in right)
    wanted = sum(r[0] for r in rows) * (middle - low) / (high - low)
    assert abs(sum(r[0] for r in left) - wanted) <= max(slack, max(r[0] for r in rows))
    check_kd(left, spans, slack, low, middle)
    check_kd(right, spans, slack, middle, high)


def test_op4_is_a_kd_tree(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").collect()
    order = lambda x: -1 if x is None else int.from_bytes((x.encode() + bytes(6))[:6])
    first = {}
    for d in docs:
        a, b = first.get(d.text, (1 << 60, 1 << 60))
        first[d.text] = min(a, order(d.lang)), min(b, order(d.source))
    shard = {r.doc_id: r.shard for r in sharding.op4_kd_shards(spark, sf_dir).collect()}
    rows = [(len((d.text or "").encode()) + 1, *first[d.text], shard[d.doc_id]) for d in docs]
    spans = [max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in range(3)]
    check_kd(rows, spans, 0.005 * sum(r[0] for r in rows) / 8, 0, 8)


def test_op4_takes_odd_rows(spark):
    rows = [(k % 20, "x" * (k % 7) if k % 5 else None, None, "s", 1, 2) for k in range(200)] + [(7, "y" * 200_000, "en", "s", 1, 2)] * 2
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, print int")).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r[0], len(r[1] or "") + 1) for r in rows)


def test_op4_splits_a_group_only_for_balance(spark):
    rows = [(k, "same text" if k < 300 else f"text {k} " + "x" * (k % 50), "en", f"s{k % 3}") for k in range(400)] + [(401, None, None, None)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(got) == 401 and max(sizes.values()) - min(sizes.values()) <= 2 * 60
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert sharding.shard_documents(empty).count() == 0


def test_op5_leaves_out_unfit_vectors_and_orders_ties(spark):
    nan = float("nan")
    rows = [(0, [1.0, -0.5]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, None), (6, [float("inf"), 0.0]), (20, [0.01, -3.2]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*x, 9) for x in rows], "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F

    got = {}
    for r in topk.search(df, F.col("id") % 20 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = {i: [int(np.floor(64 * np.float64(np.float32(c)))) for c in e] for i, e in rows if i not in (3, 4, 5, 6)}
    want = {}
    for q in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:3]
        want[q] = [(k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.search(df.where("vec_id < 0"), F.col("id") % 20 == 0).count() == 0


def test_op5_takes_all_finite_components_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    wide = [2.0**45, -(2.0**45), 3.0, 1e15, -0.5, 0.0]
    rows = [(int(k), [float(x) for x in r.choice(wide, 3)]) for k in r.integers(0, 60, 400)] + [(20, []), (40, []), (41, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [[int(np.floor(64 * x)) for x in v] for _, v in rows]
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), j) for c, (j, w) in enumerate(rows) if c != q and len(w) == len(v))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    got = sorted((x.query_id, x["rank"], x.vec_id, int(x.score)) for x in topk.search(df, F.col("id") % 20 == 0, k=5).collect())
    assert got == sorted(want) and max(x[3] for x in got) > 2**63


def test_op7_templates_fold_and_render():
    tree = chat.fold(chat.parse("{% if 'a' == 'a' %}x{{ 'b' | upper }}{% else %}y{% endif %}{% for m in messages %}[{{ m.text | escape }}]{% endfor %}"))
    assert tree[0] == ("text", "xB")
    render = chat.compile_template("{% for m in messages %}{% generation %}{{ m.role + '!' }}{% endgeneration %}{{ m.index }}{% endfor %}")
    assert list(render(iter([{"role": "a", "text": "", "index": "0"}]))) == [("a!", True), ("0", False)]
    for bad in ("{% for x in files %}{% endfor %}", "{{ m.__class__ }}", "{{ open('x') }}", "{% if 'a' %}", "{{ 'a' | exec }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_op7_escapes_reversibly(spark):
    texts = [r"\### a </turn>", "\\", "### ### ", "</turn>\n### user:\n", "x:\n:\n", "", None, "\\\\:\n"]
    for text in texts:
        assert chat.unescape(chat.escape(text or "")) == (text or "")
        assert not re.search(r"(?<!\\)(### |</turn>)", chat.escape(text or "").replace("\\\\", ""))
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, None, None, "a"), (2, None, None, "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    said = [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(texts)]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(b for a, b in said if a == "assistant").encode()).hexdigest()
    assert (got[1].n_turns, got[2].n_turns, got[2].loss_chars) == (len(texts), 2, 0)


def test_op8_learns_quality_on_held_out_rows(spark, sf_dir, docs):
    labels = {r.doc_id: r.quality for r in common.table(spark, sf_dir, "labels").collect()}
    rows = quality.op8_quality(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == len(docs) and np.mean(judged) > 0.85
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    assert all(r.score == 0.5 for r in quality.score(odd, quality.fit(common.table(spark, sf_dir, "documents").limit(0).selectExpr("*", "1 AS quality"))).collect())


def reference_ids(text):
    import base64

    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return [encoding.encode_ordinary(t or "") for t in text]


def test_op9_encodes_as_the_library_and_decodes(spark, sf_dir, docs):
    got = {r.doc_id: r for r in bpe.op9_byte_bpe(spark, sf_dir).collect()}
    for (i, text), ids in zip(docs, reference_ids([t for _, t in docs])):
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op9_stitches_chunks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 200)
    monkeypatch.setattr(bpe, "OVERLAP", 40)
    r = np.random.default_rng(6)
    parts = ["a" * 50, " the ", " \n\n ", "don't ", "é", "123", "  ", "ß!!", "\t", "漢字"]
    rows = [(k, "".join(parts[x] for x in r.integers(0, len(parts), r.integers(0, 250)))) for k in range(40)] + [(90, None), (91, ""), (92, "x" * 3000), (92, "x" * 3000), (93, " " * 1000)]
    path, pattern = bpe.default_vocabulary()
    got = sorted((x.doc_id, list(x.ids)) for x in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, pattern, long_text=200).collect())
    assert got == sorted((k, ids) for (k, _), ids in zip(rows, reference_ids([t for _, t in rows])))


def test_op10_names_languages_of_held_out_rows(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in common.table(spark, sf_dir, "documents").collect()}
    rows = langid.op10_language_id(spark, sf_dir).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(truth) and np.mean(held) > 0.9
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !!", "en"), (4, "the and of", "en")], "doc_id long, text string, lang string")
    network, classes = langid.fit(odd)
    assert {r.doc_id: r.lang_pred for r in langid.predict(odd, network, classes).collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).limit(0)).collect()} == set()


def test_op2_short_items_nulls_and_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "!!"), (4, " ".join(f"w{k}" for k in range(20))), (1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "x ALPHA beta, gamma y"), (2, None), (3, ""), (4, "w0 " + " ".join(f"w{k}" for k in range(2, 16))), (5, "alpha beta x gamma"), (5, "alpha beta x gamma")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, row int")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r.item_ids)) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(1, 5, 3, 1, ["1"]), (2, 0, 0, 0, []), (3, 0, 0, 0, []), (4, 15, 14, 1, ["4"]), (5, 4, 0, 0, []), (5, 4, 0, 0, [])]
    near = decontaminate.Index(docs, items).near(3, 4)
    assert sorted((r.item_id, r.n_near) for r in near.collect() if r.item_id == "1") == [("1", 1), ("1", 1), ("1", 1)]


def test_clashing_names_and_repeated_rows_are_defined(spark):
    rows = [(1, "the same line of two documents\nown line one", "en", "s", 1, 2, 3.0), (1, "the same line of two documents\nown line one", "en", "s", 1, 2, 3.0), (2, "the same line of two documents\nsecond " + "word " * 30_000, "en", "s", 1, 2, 3.0), (3, None, None, None, 1, 2, 3.0), (4, "", "en", "s", 1, 2, 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _text int, node int, score double")
    network, classes = langid.fit(df)
    found = langid.predict(df, network, classes, keep=df.columns)
    assert sorted(r.doc_id for r in found.collect()) == [1, 1, 2, 3, 4] and found.columns == [*df.columns[:-1], "lang_pred", "score"]
    assert [r._text for r in found.collect()] == [1] * 5
    kept = sorted((r.doc_id, r.text) for r in lines.dedup(df).where("doc_id < 3").collect())
    assert kept[0] == kept[1] == rows[0][:2] and kept[2][1].startswith("second word")
    path, pattern = bpe.default_vocabulary()
    assert sorted(r.doc_id for r in bpe.encode(df, path, pattern, decoded=True).collect()) == [1, 1, 2, 3, 4]
    assert all(bytes(r.decoded).decode() == (t or "") for r, t in zip(sorted(bpe.encode(df, path, pattern, decoded=True).collect(), key=lambda r: r.doc_id), [x[1] for x in rows]))
    scored = quality.score(df, quality.fit(df.selectExpr("*", "doc_id % 2 AS quality")))
    assert sorted(r.doc_id for r in scored.collect()) == [1, 1, 2, 3, 4]
    grouped = sorted((r.doc_id, r.component_id) for r in jaccard.join(df).collect())
    assert grouped == [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4)]


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_decontamination", "op3_line_dedup", "op6_ngram_jaccard", "op8_quality", "op9_byte_bpe", "op10_language_id"])
def test_queries_take_an_empty_table(spark, sf_dir, tmp_path, name):
    for table in ("documents", "benchmark", "labels"):
        common.table(spark, sf_dir, table).limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_op5_ranks_scores_beyond_38_digits(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [3e18, 0.0]), (3, [2e18, 0.0]), (4, [-3e18, 0.0]), (5, [-2e18, 5.0]), (6, [2e18, 0.0]), (7, [1e300, 0.0]), (8, [-1e300, 0.0])]
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=8).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [7, 2, 3, 6, 1, 5, 4, 8]
    wide = [10**k + d for k in (38, 39, 60) for d in (0, 1)] + [-(10**k) - d for k in (38, 39, 60) for d in (0, 1)] + [10**38 - 1, 1 - 10**38]
    assert sorted(wide, key=topk.sortable) == sorted(wide) and topk.sortable(5) is None


def test_op3_compares_lines_without_white_space_at_either_end(spark):
    rows = [(1, "Read more\nfirst"), (2, "Read more\r\nsecond\r\n\r\n"), (3, "\tRead more\x0c\n \t\nthird"), (4, " \r\n\t")]
    got = {x.doc_id: x.text for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows) == {1: "Read more\nfirst", 2: "second\r\n\r\n", 3: " \t\nthird", 4: " \r\n\t"}


def test_op3_writes_little_beside_its_lines(spark, monkeypatch):
    r, rows = random.Random(9), []
    for k in range(500):  # near copies: all lines are candidates
        line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)).strip()
        rows += [(2 * k, line), (2 * k + 1, line[:150] + "#" + line[150:])]
    written, real = {}, common.materialize

    def told(df, label):
        out = real(df, label)
        folder = pathlib.Path(out.scratch_path.removeprefix("file:"))
        written[label] = written.get(label, 0) + sum(f.stat().st_size for f in folder.glob("*.parquet"))
        return out

    monkeypatch.setattr(common, "materialize", told)
    got = {x.doc_id: x.text for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t if i % 2 == 0 else "" for i, t in rows}
    # Packed as 64-bit numbers, the shingles of a line take eight times its bytes.
    assert written["sets"] < 2 * sum(len(t) for _, t in rows)


def test_op1_gives_the_same_without_broadcasts_and_shuffles_few_texts(spark, sf_dir, monkeypatch):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "q" * 500), (None, None), (1, "z" * 450)], "doc_id long, text string"))
    seen = lambda df: sorted((str(r.doc_id), r.text or "", str(r.spans)) for r in df.collect())
    want, frames = seen(suffixes.repeated_spans(docs)), []
    flagged = suffixes._flagged
    monkeypatch.setattr(common, "within", lambda df, most=0: "_bits" in df.columns)
    monkeypatch.setattr(suffixes, "_flagged", lambda rows, *more: frames.append(flagged(rows, *more)) or frames[-1])
    assert seen(suffixes.repeated_spans(docs)) == want
    assert len(frames) == 2 and all(0 < f.where("_may").count() < 0.75 * f.count() for f in frames)
