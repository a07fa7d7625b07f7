"""Each operator against a plain version or an exact property, with nulls, empty and repeated rows, clashing names and empty tables."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, components, decontamination, html, jaccard, language, pieces, pitman_yor, quality, queries, quotations, syncmers, toxicity
from tidemark.llm.texts import fold, words

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


def odd(spark):
    """Nulls in every column, empty and blank texts, repeats, one long text, and columns that clash with operators' names."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one two three", "en", "s", 13), (4, "one two three", "en", "s", 13), (None, "one two three", "de", None, 13), (5, "word " * 30_000, "en", "s", 1), (6, "x" * 20_000, None, "s", 2), (7, "!!! ??? 123", "fr", "s", 3)]
    return spark.createDataFrame(rows, DOC).withColumns({"score": F.lit("mine"), "key": F.lit(1), "r": F.lit(2), "n": F.lit(3), "root": F.lit(4), "id": F.lit(5), "a": F.lit(6), "_range": F.lit(7)})


def one(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- toxicity ----------------------------------------------------------------------------------------------------------
def test_toxicity_tells_held_out_documents_apart(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() >= 0.95 and got.score.between(0, 1).all()
    assert (got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()


def test_toxicity_of_odd_rows_and_of_no_labels(spark, docs):
    none = toxicity.train(toxicity.labelled_sample(docs, one(spark, [], "doc_id long, toxic int"), "toxic"))
    got = odd(spark).select("doc_id", toxicity.toxicity(F.col("text"), none, spark).alias("t")).select("t.score").collect()
    assert [r.score for r in got] == [0.0] * 9
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(toxicity.labelled_sample(docs, labels, "toxic"))
    got = odd(spark).select(toxicity.toxicity(F.col("text"), model, spark).alias("t")).select("t.score").collect()
    assert all(0 <= r.score <= 1 for r in got) and got[3].score == got[4].score and got[0].score == got[1].score


def test_isotonic_is_monotone_and_hidden_words_are_found():
    rng = np.random.default_rng(0)
    x = rng.random(500)
    knots, p = toxicity.isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(p) >= 0).all() and abs(np.interp(0.8, knots, p) - 0.8) < 0.2
    look = toxicity.Words({"idiot": 3.0})
    assert look.look("1d1ot")[2] and look.look("i.d.i.o.t")[2] and not look.look("idiot")[2] and look.look("idiot")[0] == 3.0


# --- language model ----------------------------------------------------------------------------------------------------
def test_pitman_yor_counts_are_exact_and_better_than_the_base(spark, docs):
    rows = docs.select("doc_id", "text").union(odd(spark).select("doc_id", "text")).withColumn("held_out", fold(7) == 2)
    got = pitman_yor.language_model(rows).toPandas()
    source = rows.collect()
    assert len(got) == len(source)
    tokens = {(-1 if r.doc_id is None else r.doc_id, r.text): [*words(r.text), b"\0"] for r in source}
    seen = Counter()
    for r in source:
        if not r.held_out:
            seen.update([*words(r.text), b"\0"])
    n, v = sum(seen.values()), len(seen)
    expected = sorted((-1 if r.doc_id is None else r.doc_id, len(w := tokens[-1 if r.doc_id is None else r.doc_id, r.text]), sum(seen[x] > 0 for x in w), round(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w), 4)) for r in source)
    mine = sorted((-1 if pd.isna(r.doc_id) else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got.itertuples())
    assert mine == expected and set(got.train_tokens) == {n}
    held = got[got.held_out]
    assert (got.score < 0).all() and held.score.sum() > held.base_score.sum()


def test_pitman_yor_sums_to_one_and_repeats(spark, docs):
    rows = docs.select("doc_id", "text", F.lit(False).alias("held_out")).limit(40)
    table = spark.sparkContext.broadcast(pitman_yor.spelling(rows))
    counts = pitman_yor.counted(rows, 3, table)
    model = pitman_yor.trained(counts)
    shards = [(r.shard, pitman_yor.Counts.of(r)) for r in counts.collect()]
    everything = np.arange(pitman_yor.SPELLINGS, dtype=np.uint8)
    for k in (5, int(pitman_yor.context_of(np.array([pitman_yor.START]))[0])):
        total = 0.0
        for s, own in shards:
            p, _ = pitman_yor.Scorer(model, s, own).score(own.words, np.ones(len(own.words), np.int64), np.full(len(own.words), k, np.uint16), own.spelled)
            total += p.sum()
        unknown, _ = pitman_yor.Scorer(model, *shards[0]).score(np.arange(3, 3 + len(everything), dtype=np.uint64), np.ones(len(everything), np.int64), np.full(len(everything), k, np.uint16), everything)
        assert abs(total + unknown.sum() - 1) < 1e-9
    a, b = (pitman_yor.scored(rows, counts, model, 3, table).orderBy("doc_id").toPandas().score for _ in range(2))
    assert (a == b).all()


def test_pitman_yor_prefers_text_to_random_letters(spark):
    rnd = random.Random(3)
    junk = [(-1 - i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60)), True) for i in range(20)]
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (fold(7) == 2).alias("held_out"))
    got = pitman_yor.language_model(real.union(spark.createDataFrame(junk, real.schema))).where("held_out").toPandas()
    token = got.score / got.n_tokens
    assert token[got.doc_id < 0].max() < token[got.doc_id >= 0].median() - 1 and got.score[got.doc_id >= 0].sum() > got.base_score[got.doc_id >= 0].sum()


def test_pitman_yor_agrees_with_a_sampler_of_one_customer_at_a_time(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee", "ff", f"n{rnd.randrange(40)}"]) for _ in range(rnd.randrange(3, 12))) for _ in range(60)]
    rows = spark.createDataFrame([(i, x, False) for i, x in enumerate(texts)], "doc_id long, text string, held_out boolean")
    table = spark.sparkContext.broadcast(pitman_yor.spelling(rows))
    counts = pitman_yor.counted(rows, 1, table)
    model = pitman_yor.trained(counts, samples=30)
    own = pitman_yor.Counts.of(counts.first())
    of = np.repeat(np.arange(len(own.words)), own.width)
    fast, _ = pitman_yor.Scorer(model, 0, own).score(own.words, own.width, own.contexts, own.spelled)
    # the same model, with each customer taken out and seated again by itself
    d, e, theta, top = model.discount, model.parent_discount, model.strength, model.parent_strength
    seats, parents, at, up = [[] for _ in of], [[] for _ in own.words], Counter(), Counter()

    def base():
        tables = sum(map(len, parents))
        return (top + e * tables) * (1 - min(0.99, len(parents) / max(1, tables))) / len(parents)

    def parent(w):
        return (sum(parents[w]) - e * len(parents[w]) + base()) / (top + up["all"])

    def seat(tables, new, discount):
        weights = [c - discount for c in tables] + [new]
        k = rnd.choices(range(len(weights)), weights)[0]
        tables[k:k + 1] = [tables[k] + 1] if k < len(tables) else [1]
        return k == len(weights) - 1

    def add(i):
        w, k = of[i], own.contexts[i]
        at[k, "n"] += 1
        if seat(seats[i], (theta + d * at[k]) * max(parent(w), 1e-12), d):
            at[k] += 1
            up["all"] += 1
            seat(parents[w], max(base(), 1e-12), e)

    def leave(i):
        w, k = of[i], own.contexts[i]
        j = rnd.choices(range(len(seats[i])), seats[i])[0]
        at[k, "n"] -= 1
        seats[i][j] -= 1
        if not seats[i][j]:
            del seats[i][j]
            at[k] -= 1
            up["all"] -= 1
            j = rnd.choices(range(len(parents[w])), parents[w])[0]
            parents[w][j] -= 1
            if not parents[w][j]:
                del parents[w][j]

    for i, c in enumerate(own.customers):
        for _ in range(c):
            add(i)
    slow = np.zeros(len(of))
    for sweep in range(60):
        for i, c in enumerate(own.customers):
            for _ in range(c):
                leave(i)
                add(i)
        if sweep >= 20:
            slow += [(sum(seats[i]) - d * len(seats[i]) + (theta + d * at[own.contexts[i]]) * parent(of[i])) / (theta + at[own.contexts[i], "n"]) / 40 for i in range(len(of))]
    assert np.abs(np.log10(fast) - np.log10(slow)).max() < 0.25 and abs((own.customers * (np.log10(fast) - np.log10(slow))).sum() / own.customers.sum()) < 0.03


def test_pitman_yor_without_training_text(spark):
    assert pitman_yor.language_model(one(spark, [], "doc_id long, text string, held_out boolean")).count() == 0
    got = pitman_yor.language_model(one(spark, [(1, "a b", True)], "doc_id long, text string, held_out boolean")).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (3, 0, 0, 0.0)


def test_seating_has_as_many_tables_as_a_plain_restaurant():
    rng = np.random.default_rng(1)
    customers = np.full(400, 3000)
    fast = pitman_yor.seated(customers, np.full(400, 2.0), 0.5, rng)
    slow = []
    for _ in range(60):
        t = 1
        for n in range(1, 3000):
            t += rng.random() < 2.0 / (n - 0.5 * t + 2.0)
        slow.append(t)
    assert abs(fast.mean() - np.mean(slow)) < 1.5


# --- SentencePiece -----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model_file():
    return queries.PIECES


def test_pieces_equal_the_librarys_and_decode_again(spark, docs, model_file):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rnd = random.Random(5)
    extra = ["", " ", "  a  b ", "\n", "▁x", "漢字テスト", "a\x00b", "e" * 3000, "🙂 ok", "\t"] + ["".join(rnd.choice("aeth ▁inor\né漢") for _ in range(rnd.randrange(120))) for _ in range(200)]
    rows = [(i, x) for i, x in enumerate([r.text for r in docs.collect()] + extra)] + [(-1, None)]
    got = {r.doc_id: r.c for r in one(spark, rows).select("doc_id", pieces.round_trip(F.col("text"), model_file).alias("c")).collect()}
    for i, text in rows:
        if text is None:
            assert got[i].ids is None and got[i].exact is None
        else:
            assert list(got[i].ids) == lib.encode(text) and got[i].exact and got[i].n_pieces == len(got[i].ids)
    back = one(spark, rows).select("text", pieces.decode(pieces.encode(F.col("text"), model_file)["ids"], model_file).alias("back")).collect()
    assert all(r.back == (None if r.text is None else r.text.replace("▁", " ")) for r in back)


def test_units_that_come_again_are_encoded_once(model_file, monkeypatch):
    v = pieces.Vocabulary.load(model_file)
    encoded, merged = [], v.merged
    monkeypatch.setattr(v, "merged", lambda units: encoded.extend(units) or merged(units))
    monkeypatch.setattr(pieces.Vocabulary, "CACHE", 12)
    texts = ["common " + " ".join(f"w{10 * k + i}q" for i in range(8)) for k in range(6)]
    once = [v.encode([x])[0] for x in texts]
    assert encoded.count("▁common") == 1 and len(encoded) == 6 * 8 + 1
    assert once == pieces.Vocabulary.load(model_file).encode(texts)


def test_units_that_are_known_are_kept_as_numbers_and_not_as_objects(model_file):
    """Of 40,000 distinct words a worker keeps less than 100 bytes each; as strings and tuples in a dictionary they took some 500."""
    v = pieces.Vocabulary.load(model_file)
    texts = [" ".join(f"{chr(97 + k % 26)}q{k:x}z{k % 977}" for k in range(a, a + 400)) for a in range(0, 40_000, 400)]
    v.encode(["warm up"])
    tracemalloc.start()
    try:
        for t in texts:
            v.encode([t])
        kept, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 4_000_000


def test_units_of_all_lengths_kinds_and_windows_equal_the_librarys(model_file, monkeypatch):
    import sentencepiece

    lib, v = sentencepiece.SentencePieceProcessor(model_file=model_file), pieces.Vocabulary.load(model_file)
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("aeth inor\né漢🙂▁Ð") for _ in range(n)) for n in range(300)]
    texts += ["".join(rnd.choice("aethinor") for _ in range(n)) + rnd.choice(["", " ", "漢" * 70, " " * 80]) for n in range(140)] * 2
    texts += [None, "", " ", "漢", "x" * 64, "x" * 65, "x" * 64, None]
    want = [None if t is None else lib.encode(t) for t in texts]
    for window, cache in ((1 << 18, 200_000), (50, 200_000), (1, 40), (1000, 1)):
        monkeypatch.setattr(pieces, "WINDOW", window)
        monkeypatch.setattr(pieces.Vocabulary, "CACHE", cache)
        assert v.encode(texts) == want
    ids, at = v.flat(texts)
    assert v.joined(ids, at) == [(t or "").replace("▁", " ") for t in texts]


def test_characters_that_are_no_piece_themselves_are_merged_into_pieces():
    """"b" is in "ab" only; equal scores go to the leftmost pair."""
    v = pieces.Vocabulary(["<unk>", "a", "c", "ab", "ca", "cc", "ac"], [0.0, -1.0, -2.0, -3.0, -4.0, -5.0, -5.0], [False] + [True] * 6, {}, {}, 0, frozenset(), True, False, False)
    assert v.encode(["ab", "b", "cab", "ccc", "acc", "bb", "x", ""]) == [[3], [0], [2, 3], [5, 2], [6, 2], [0, 0], [0], []]
    assert all(tuple(v.encode([u])[0]) == v.merged_long(u) for u in ("ab", "cabcab", "ccacc", "accab", "bca"))


def test_unigram_units_are_told_apart_and_encoded():
    v = pieces.Vocabulary(["<unk>", "a", "b", "ab", "▁a", "<0x63>"], [0.0, -2.0, -2.5, -3.0, -1.0, 0.0], [False] + [True] * 4 + [False], {99: 5}, {5: 99}, 0, frozenset(), False, True, True)
    assert v.encode(["ab  ab", "c", None, "a" * 70 + " ab"]) == [[4, 2, 4, 2], [0, 5], None, [4] + [1] * 69 + [4, 2]]


def test_viterbi_finds_the_best_path():
    v = pieces.Vocabulary(["<unk>", "a", "b", "ab", "ba", "aba", "bb"], [0.0, -2.0, -2.5, -3.0, -3.2, -4.0, -9.0], [False] + [True] * 6, {}, {}, 0, frozenset(), False, False, False)
    rnd = random.Random(2)
    units = ["".join(rnd.choice("abc") for _ in range(n)) for n in (1, 2, 5, 9) for _ in range(30)]
    for n in (1, 2, 5, 9):
        group = [u for u in units if len(u) == n]
        for unit, ids in zip(group, v.viterbi(group), strict=True):
            best = [0.0] + [-math.inf] * n
            for e in range(1, n + 1):
                for s in range(e):
                    part = unit[s:e]
                    score = v.scores[v.number[part]] if part in v.number else -19.0 if e - s == 1 else -math.inf
                    best[e] = max(best[e], best[s] + score)
            assert abs(sum(v.scores[i] if i else -19.0 for i in ids) - best[n]) < 1e-9


# --- HTML --------------------------------------------------------------------------------------------------------------
PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Home</a><li><a href=y>About us and what we do here</a></ul></nav><div class="cookie-notice">We use cookies &amp; more</div>
<div id=main><article><h2>Head &lt;1&gt;</h2><p>First   paragraph with <b>bold</b> text &amp; more words in it.<p>Second&nbsp;paragraph<br>goes on for a while, with many words.</p>
<aside>Related: buy this</aside><form>Name <input name=q><button>Send</button></form><p>Short.</p><div class="comments"><p>First reader comment, which is a long text of its own, with words.</p></div></article></div>
<div class="sidebar"><p>Other</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = one(spark, [(1, PAGE), (2, None), (3, ""), (4, "just text"), (5, "<p>a<p>b"), (6, "<nav>only menu</nav>")], "page_id int, html string")
    got = {r.page_id: r.m for r in rows.select("page_id", html.main_text(F.col("html")).alias("m")).collect()}
    assert got[1].text == "Head <1>\n\nFirst paragraph with bold text & more words in it.\n\nSecond paragraph goes on for a while, with many words.\n\nShort."
    assert [got[k].text for k in (2, 3, 4, 5, 6)] == ["", "", "just text", "a\n\nb", ""]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_main_text_keeps_sections_of_unequal_size():
    words = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    for outer in ("article", "main", "div"):
        for inner in ("section", "div", "blockquote"):
            parts = [words(40, "intro"), words(400, "large"), words(60, "middle"), words(50, "last")]
            body = "".join(f"<{inner}><h2>Heading {k}</h2><p>{p}</p></{inner}>" for k, p in enumerate(parts))
            text = html.extract(f"<body><nav><a href=x>Home</a></nav><{outer}><h1>Title</h1>{body}</{outer}><footer>f</footer></body>")[0]
            assert text.split("\n\n") == ["Title", *(y for k, p in enumerate(parts) for y in (f"Heading {k}", p))], (outer, inner)
    many = "".join(f"<article><p>{words(n, 'w')}</p></article>" for n in (30, 400, 30))
    assert html.extract(f"<body>{many}</body>")[0].split().count("w29") == 3


def test_main_text_with_one_huge_paragraph():
    plain = "".join(f"<section><h2>Part {k}</h2><p>An ordinary paragraph of part {k} that says something in a sentence of usual length, as texts do.</p></section>" for k in range(6))
    for outer in ("article", "div"):
        text = html.extract(f"<body><{outer}>{plain}<section><p>{'word ' * 5000}</p></section></{outer}></body>")[0]
        assert all(f"paragraph of part {k} " in text and f"Part {k}" in text for k in range(6))


FIXED_PAGES = [
    # (body, text): hand-written, most without semantic tags
    ('<div class="layout has-sidebar"><p>{L1}</p></div><div class="x"><p>tiny</p></div>', "L1"),
    ('<div id="top"><a href=a>Home</a> <a href=b>News</a></div><div><h2>Head</h2><p>{L1}</p><p>{L2}</p></div><div class="ads"><p>{A}</p></div>', "Head L1 L2"),
    ('<div class="wrap"><div class="post"><h1>Title</h1><p>{L1}</p><p>Short.</p><p>{L2}</p></div><div class="sidebar"><p>{A}</p></div></div>', "Title L1 Short. L2"),
    ('<form id="aspnet"><div><p>{L1}</p><p>{L2}</p></div><div class="footer"><p>{A}</p></div></form>', "L1 L2"),
    ('<main><h1>T</h1><section><p>{L1}</p></section><section><p>Few words.</p></section><section><p>{L2}</p></section></main><div class="cookie-notice">{A}</div>', "T L1 Few words. L2"),
    ('<article><p>{L1}</p><div class="x9"><a href=1>one of many</a><a href=2>two of many</a><a href=3>three of many</a></div><p>{L2}</p></article>', "L1 L2"),
    ('<article><p>{L1}</p></article><div id="comments"><article class="comment"><p>{A}</p></article><article class="comment"><p>{A}</p></article></div>', "L1"),
    ('<table><tr><td><a href=a>m1</a><br><a href=b>m2</a></td><td><p>{L1}</p><p>{L2}</p></td></tr></table>', "L1 L2"),
    ('<div role="banner"><p>{A}</p></div><div role="main"><p>{L1}</p></div><div role="contentinfo"><p>{A}</p></div>', "L1"),
    ('<div class="comments-open page"><p>{L1}</p><p>{L2}</p></div>', "L1 L2"),
    ('<div hidden><p>{A}</p></div><p>{L1}<div style="display: none">{A}</div><p>{L2}', "L1 L2"),
    ('<p>{L1}</p><ul><li>first point</li><li>second point</li></ul><p>{L2}</p>', "L1 | first point | second point | L2"),
    ('<article><blockquote><p>{L1}</p></blockquote><p>Who said that?</p></article><aside>{A}</aside>', "L1 | Who said that?"),
    ('<div class="ad">{A}</div><article><h1>T</h1><p>Tiny page.</p></article>', "T | Tiny page."),
    ('<header><p>{A}</p></header><article><header><h1>Inner</h1></header><p>{L1}</p></article>', "L1"),
    ('<article><pre>a  b\n c</pre><p>{L1}</p></article>', "a b c | L1"),
    ('<div class="nav-menu">{A}</div><div class="entry-content"><p>{L1}</p></div><div class="share-buttons">Share this page with all</div>', "L1"),
    ('<article><p>{L1}</p><script>var a = "<p>{A}</p>";</script><!-- {A} --><p>x &lt; y &amp; z &eacute;&#233;</p></article>', "L1 | x < y & z éé"),
    ('<div><div><div><p>{L1}</p></div></div></div><div class="newsletter-signup"><form><p>{A}</p></form></div>', "L1"),
    ('<section class="related-posts"><a href=1>{A}</a></section><main><p>{L1}</p><p>{L2}</p></main>', "L1 L2"),
]


def test_main_text_of_fixed_pages():
    long = {"L1": " ".join(f"first{k}" for k in range(60)), "L2": " ".join(f"second{k}" for k in range(45)), "A": " ".join(f"aside{k}" for k in range(20))}
    for body, want in FIXED_PAGES:
        for key, text in long.items():
            body = body.replace("{" + key + "}", text)
        parts = want.split(" | ") if "|" in want else [w for w in want.replace("Few words.", "Few_words.").split()]
        assert html.extract(f"<html><body>{body}</body></html>")[0].split("\n\n") == [long.get(p, p.replace("_", " ")) for p in parts], body


def test_smoothing_decides_which_lines_are_content(monkeypatch):
    long = " ".join(f"word{k}" for k in range(60))
    links = "".join(f"<div><a href={k}>link {k}</a></div>" for k in range(4))
    page = f"<body><div>{links}</div><div>{links}<div>A lonely line among links of forty odd letters.</div>{links}</div><div>By one of us</div><div><p>{long}</p><p>{long}</p></div><div>The end of it</div><div>{links}</div></body>"
    assert html.extract(page)[0].split("\n\n") == ["By one of us", long, long, "The end of it"]
    monkeypatch.setattr(html, "smoothed", lambda ratio, sigma: ratio)
    alone = html.extract(page)[0]
    assert "lonely" in alone and "The end" not in alone


def test_main_text_of_odd_pages(spark):
    """Repeated rows, clashing names, a very long page, elements that are never closed, an empty table."""
    long = "<div>" * 3000 + "<p>" + "word " * 200_000
    rows = spark.createDataFrame([(1, "<p>a b", "x", 1), (1, "<p>a b", "x", 1), (None, long, None, 2)], "page_id int, html string, text string, n_chars int")
    got = rows.select("page_id", "text", "n_chars", html.main_text(F.col("html")).alias("m")).collect()
    assert [r.m.text for r in got[:2]] == ["a b", "a b"] and got[2].m.n_chars == 999_999 and got[0].text == "x"
    assert rows.where("false").select(html.main_text(F.col("html")).alias("m")).count() == 0


# --- Jaccard -----------------------------------------------------------------------------------------------------------
def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {b" ".join(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_loses_no_link(spark, size, percent):
    rnd = random.Random(size)
    base = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for _ in range(90):
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice("xyzw")
        rows.append((len(rows), rnd.choice([" ", "\n"]).join(w).upper()))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "b a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(one(spark, rows), size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_jaccard_loses_no_link_in_a_large_group_of_near_copies(spark):
    """Copies that differ from the one they come from by more than the limit, but not from one another, beside texts that share a long line."""
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    line = [f"l{k}" for k in range(40)]
    rows = []
    for i in range(170):
        w = list(base)
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.choice(range(0, 120, 9))] = rnd.choice(["", "x", f"u{i}"])
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([*line, *(f"o{rnd.randrange(4000)}" for _ in range(rnd.randrange(3, 60)))])) for i in range(110)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(one(spark, rows), 4, 85).collect()}
    want = brute(rows, 4, 85)
    assert got == want and 1 < len({c for i, (_, c) in want.items() if i < 200}) < 100


def test_jaccard_of_odd_and_no_rows(spark):
    got = jaccard.jaccard_components(odd(spark)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (None, None), (5, 5), (6, 6), (7, 7)], key=str)
    assert jaccard.jaccard_components(one(spark, [])).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7), (None, 3)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    got = {r.id: r.root for r in components.components(one(spark, chain, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in chain:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root if find(x) != x}


# --- language ----------------------------------------------------------------------------------------------------------
def test_language_of_held_out_documents(spark):
    got = queries.op6_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()


def test_language_of_odd_rows(spark, docs):
    model = language.train(docs.where(fold(4) != 2))
    got = odd(spark).select("text", language.language(F.col("text"), model, spark).alias("p")).select("text", "p.*").collect()
    assert [r.lang_pred for r in got if not r.text or not any(map(str.isalpha, r.text))] == ["und"] * 4
    none = language.train(docs.where("false"))
    assert {r.p.lang_pred for r in odd(spark).select(language.language(F.col("text"), none, spark).alias("p")).collect()} == {"und"}


def test_language_learns_from_distinct_texts_however_often_copied(spark):
    texts = [(f"l{k}", " ".join(chr(97 + 3 * k + (i + j) % 3) * (1 + j % 3) for j in range(20 + i))) for k in range(8) for i in range(3)]
    rows = one(spark, texts, "lang string, text string")
    copied = rows.crossJoin(spark.range(4000)).select("lang", "text")
    model, plain = language.train(copied), language.train(rows)
    assert model.languages == [f"l{k}" for k in range(8)] == plain.languages
    assert np.array_equal(model.idf, plain.idf) and np.array_equal(model.centroids, plain.centroids)


# --- quality -----------------------------------------------------------------------------------------------------------
def test_quality_keeps_trusted_text_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() >= 0.98 and got[got.quality == 0].keep.mean() <= 0.3


def plain_kneser_ney(texts, n=quality.ORDER):
    """p(character after context) by nested dictionaries; ``texts``: the trusted ones."""
    grams = Counter()
    for x in texts:
        s = "\ue001" * (n - 1) + x.replace("\0", "\ue000") + "\ue002"
        grams.update(s[k : k + n] for k in range(len(s) - n + 1))
    levels = {n: grams}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    return levels


def plain_discounts(two):
    """From the counts of counts of both folds' tables together."""
    of = Counter(c for level in two for c in level.values())
    if not all(of[k] for k in (1, 2, 3)):
        return [0.5, 0.75, 1.0]
    y = of[1] / (of[1] + 2 * of[2])
    return [min(max(0.05, k - (k + 1) * y * of[k + 1] / of[k]), k - 0.05) for k in (1, 2, 3)]


def plain_score(text, levels, d, n=quality.ORDER):
    sums = {}
    for k, level in levels.items():
        for g, c in level.items():
            x = sums.setdefault((k, g[:-1]), [0, 0.0])
            x[0] += c
            x[1] += d[k][min(c, 3) - 1]
    s, out = "\ue001" * (n - 1) + text + "\ue002", 0.0
    for at in range(n - 1, len(s)):
        p = 1 / (len(levels[1]) + 1)
        for k in range(1, n + 1):
            g = s[at - k + 1 : at + 1]
            c, (total, cut) = levels[k][g], sums.get((k, g[:-1]), (0, 0.0))
            if total:
                p = (c - d[k][min(c, 3) - 1] if c else 0.0) / total + cut / total * p
        out += math.log10(p)
    return out


def test_quality_equals_a_plain_model(spark):
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("abcde  \n") for _ in range(rnd.randrange(1, 60))) + "x" for _ in range(50)]
    rows = [(i, rnd.choice(pool) if i % 3 else pool[i % 50] + "é梦", "en" if i % 2 else None) for i in range(120)] + [(500, None, "en"), (501, "", "en"), (502, " \n ", "en"), (None, "abc", "de"), (503, "qqq 🙂", "en"), (503, "qqq 🙂", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(110)] + [(None, 1)], "doc_id long, quality int")
    got = quality.classify(docs.withColumns({"_limit": F.lit(1), "h": F.lit(2), "p": F.lit(3), "f": F.lit(4)}), labels).collect()
    fold = {r.text: r.f for r in docs.where("text is not null").select("text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()}
    trusted = [x for i, x, _ in rows if i is not None and i < 110 and i % 4]
    models = {f: plain_kneser_ney([x for x in trusted if fold[x] == f]) for f in (0, 1)}
    d = {k: plain_discounts([models[0][k], models[1][k]]) for k in range(1, quality.ORDER + 1)}
    want = {x: plain_score(x, models[1 - fold[x]], d) for _, x, _ in rows if x and x.strip()}
    assert len(got) == len(rows) and got[0]["_limit"] == 1 and got[0]["h"] == 2
    for r in got:
        if r.text in want:
            assert r["_quality"].n_tokens == len(r.text) + 1 and abs(r["_quality"].log10_probability - want[r.text]) < 1e-4 * len(r.text) + 1e-5
        else:
            assert r["_quality"].perplexity is None and not r["_quality"].keep
    # the limit of a language is the quantile of its trusted documents; a language with few takes that of all
    of = lambda lang: sorted(10 ** (-want[x] / (len(x) + 1)) for i, x, g in rows if i is not None and i < 110 and i % 4 and lang in (g, None))
    limits = {r.lang: r["_quality"].limit for r in got}
    assert abs(limits["en"] - of("en")[-1]) < 1e-3 * limits["en"] and abs(limits["de"] - of(None)[-1]) < 1e-3 * limits["de"]


def test_quality_splits_texts_and_blocks_without_a_difference(spark, docs, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = docs.select("doc_id", "text", "lang")
    whole = {r.doc_id: r.q for r in quality.classify(some, labels).select("doc_id", F.col("_quality.log10_probability").alias("q")).collect()}
    text = "é" * 7 + "abc def\n\0" * 40
    grams = lambda x: [tuple(r.grams[k]) for r in quality.runs([x]) for k in r.of]
    whole_text = grams(text)
    monkeypatch.setattr(quality, "RUN", 50)
    assert grams(text) == whole_text and len(whole_text) == len(text) + 1
    assert [len(list(quality.symbols("x" * n))) for n in (0, 1, 49, 50, 51)] == [1, 1, 1, 2, 2]
    monkeypatch.setattr(blocks, "BLOCK", 20_000)
    monkeypatch.setattr(quality, "SHARD", 9_000)
    monkeypatch.setattr(quality, "KNOWN", 100)
    parts = {r.doc_id: r.q for r in quality.classify(some, labels).select("doc_id", F.col("_quality.log10_probability").alias("q")).collect()}
    assert all(abs(parts[i] - q) < 1e-3 for i, q in whole.items() if q is not None)


def test_quality_of_odd_rows_no_labels_and_no_documents(spark):
    got = quality.classify(odd(spark), one(spark, [], "doc_id long, quality int")).select("text", "_quality.keep").collect()
    assert all(r.keep == bool((r.text or "").strip()) for r in got) and len(got) == 9
    assert quality.classify(one(spark, [], DOC), one(spark, [(1, 1)], "doc_id long, quality int")).count() == 0


# --- syncmers ----------------------------------------------------------------------------------------------------------
def test_syncmers_are_chosen_by_their_edges_alone(spark):
    text = " ".join(f"w{i * 7919 % 97}x{i}" for i in range(120))
    rows = one(spark, [(1, text), (2, "changed start here " + text[60:]), (3, None), (4, "ab"), (5, " ")])
    got = {r.doc_id: r for r in rows.select("doc_id", syncmers.inner_values(F.coalesce("text", F.lit(""))).alias("h"), syncmers.anchors(F.col("text")).alias("a")).collect()}
    h, found = got[1].h, [a["at"] for a in got[1].a]
    r = syncmers.REACH
    assert found == [i for i in range(len(h) - r) if h[i] <= min(h[i + 1 : i + r]) or h[i + r] <= min(h[i + 1 : i + r])]
    shared = {a["hash"] for a in got[1].a} & {a["hash"] for a in got[2].a}
    assert len(shared) > 0.7 * len(found)
    assert (len(got[3].a), len(got[4].a), len(got[5].a)) == (0, 1, 0)


def anchors_by(h):
    """Places of the closed syncmers of inner values, by a loop."""
    r = syncmers.REACH
    if len(h) <= r:
        return [0] if h else []
    return [i for i in range(len(h) - r) if min(h[i], h[i + r]) <= min(h[i + 1 : i + r])]


def test_next_rows_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "CUTS", 2)
    rnd = random.Random(6)
    for ids in ([rnd.randrange(1000) for _ in range(300)], [k * k * k for k in range(200)], [7] * 50, [-(2**62), 2**62, 5, None]):
        rows = [(i, f"t{k}") for k, i in enumerate(ids)]
        got = sorted((((r.doc_id is not None, r.doc_id or 0), r.text, r.next.text) for r in syncmers.with_next(one(spark, rows), ["text"], {"v": F.length("text")}, rows_per_range=10).collect()))
        order = sorted(((i is not None, i or 0), x) for i, x in rows)
        assert got == sorted((*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))


def test_fingerprints_of_edited_and_next_documents(spark, docs):
    import hashlib

    got = {r.doc_id: r for r in queries.op8_syncmers(spark, SF).collect()}
    source = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    assert len(got) == len(source)
    cut = lambda x, y: x[: len(x) - len(x) // 2] + y[: len(x) // 2]
    texts = sorted({x for _, x in source} | {cut(x, y) for (_, x), (_, y) in zip(source, source[1:] + source[:1], strict=True)})
    found = one(spark, list(enumerate(texts))).select("text", syncmers.inner_values(F.col("text")).alias("h"), syncmers.anchors(F.col("text")).alias("a")).collect()
    assert all([x["at"] for x in r.a] == anchors_by(r.h) for r in found)
    known = {r.text: r.a for r in found}
    anchors_of = known.__getitem__

    def plain_fingerprint(x):
        values = list(dict.fromkeys(a["hash"] & 0xFFFFFFFF for a in known[x]))
        return values, "".join(f"{v:08X}" for v in values)

    for k, (i, text) in enumerate(source):
        after = source[(k + 1) % len(source)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert plain_fingerprint(edited)[1] == r.edited_fingerprint and plain_fingerprint(text)[1] == r.fingerprint
        a, b, c = (set(plain_fingerprint(x)[0]) for x in (text, edited, after))
        like = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12
        assert r.aligned_edited <= len(anchors_of(text)) and (edited != text or r.aligned_edited == len(anchors_of(text)))
        if edited == text:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_positional_matches_and_next_of_odd_rows(spark):
    text = " ".join(f"w{i * 31 % 89}" for i in range(200))
    found = syncmers.matches(one(spark, [(1, text)]), one(spark, [(2, "zz yy xx " + text)])).first()
    assert found.other_id == 2 and found.shift == -3
    rows = syncmers.with_next(odd(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], {"v": F.length("text")}, rows_per_range=2).collect()
    assert len(rows) == 9
    assert syncmers.with_next(one(spark, []), ["text"], {"v": F.length("text")}).count() == 0


def test_no_python_in_the_native_operators(spark, docs):
    messages = one(spark, [(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for frame in (queries.op8_syncmers(spark, SF), quotations.conversations(messages)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- decontamination ---------------------------------------------------------------------------------------------------
def test_decontamination_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE["op9_decontamination"]).df().sort_values("doc_id", ignore_index=True)
    got = queries.op9_decontamination(spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)


def test_decontamination_of_many_blocks_and_odd_rows(spark):
    items = one(spark, [("a", "one, two THREE four five six seven eight nine ten eleven"), ("b", "short item"), ("c", None), ("d", ""), (None, "lonely words")], "item_id string, text string")
    text = "Zero one two; three four five six seven eight nine ten ELEVEN end. A short-item, lonely words"
    rows = one(spark, [(1, text), (2, None), (3, ""), (4, "nothing here"), (5, "shorté item")])
    for block in (3, 500_000):
        r = {x.doc_id: x.c for x in rows.select("doc_id", decontamination.contamination(F.col("text"), items, block_words=block).alias("c")).collect()}
        assert (r[1].n_words, r[1].n_hit, list(r[1].item_ids)) == (18, 15, ["a", "b"])
        assert [r[k].n_hit for k in (2, 3, 4, 5)] == [0] * 4 and r[2].n_words == 0
    cut = rows.select("doc_id", decontamination.without_spans(F.col("text"), decontamination.contamination(F.col("text"), items)["spans"]).alias("t")).collect()
    assert cut[0].t == "Zero  end. A " and cut[3].t == "nothing here" and cut[1].t is None


# --- quotations --------------------------------------------------------------------------------------------------------
def test_quotes_link_to_what_they_answer(spark):
    rows = [
        (1, 0, "user", "How do I boil eggs?\n\nAnd for how long?"),
        (1, 1, "assistant", "Put them into water.\nTen minutes."),
        (1, 2, "user", "> And for how   LONG?\nI mean soft ones."),
        (1, 3, "assistant", "Ann wrote:\n> > How do I boil eggs?\n> Put them into water.\nSix then.\n\n> unknown line"),
        (1, 4, "user", None), (2, 0, "user", "> quoting nobody"), (None, 0, "user", "hi"), (1, 0, "user", "How do I boil eggs?\n\nAnd for how long?"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 7
    assert (got[1, 2].reply_to, got[1, 2].text) == (1, "I mean soft ones.")
    assert (got[1, 3].reply_to, got[1, 3].text) == (2, "Six then.")
    assert got[1, 1].reply_to == 1 and got[1, 0].reply_to is None and got[1, 4].text == ""
    assert (got[2, 0].text, got[2, 0].quotes) == ("", 0)
    order = [r.turn for r in sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: r.position)]
    assert all(r.reply_to is None or order.index(r.turn) > order.index(r.reply_to - 1) for r in got.values() if r.conv_id == 1)


def plain_conversations(rows):
    """The same by loops over each conversation; ``rows``: (conversation, turn, role, text)."""
    import re

    def lines(text):
        out = []
        for x in re.sub(r"\r\n?", "\n", text or "").split("\n"):
            mark = re.match(r"[ \t]*((?:>[ \t]*)+)", x)
            out.append((mark[1].count(">") if mark else 0, x[mark.end() :] if mark else x))
        keep = []
        for i, (level, x) in enumerate(out):
            after = out[i + 1] if i + 1 < len(out) else None
            if after and not after[1].strip(" ") and after[0] == level:
                after = out[i + 2] if i + 2 < len(out) else None
            if not (re.search(r"(?i)\b(wrote|schrieb|a écrit|escribió)\s*:\s*$", x) and after and after[0] > level):
                keep.append((level, x))
        return keep

    def passages(text):
        out = []
        for level, x in lines(text):
            if out and out[-1][0] == level:
                out[-1][1].append(x)
            else:
                out.append((level, [x]))
        return [(level, "\n".join(x)) for level, x in out]

    norm = lambda x: re.sub(r"[\s>]+", " ", x.lower()).strip(" ")
    result, by = {}, {}
    for r in set(rows):
        by.setdefault(r[0] if r[0] is not None else r, []).append(r)
    for key, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or ""))
        first, answers, children = {}, {}, {}
        for k, r in enumerate(own, 1):
            found = []
            for level, x in passages(r[3]):
                if level:
                    for q in dict.fromkeys([x, *x.split("\n")]):
                        if norm(q) in first:
                            found.append((-level, len(norm(q)), first[norm(q)]))
            answers[k] = (max(found)[2] if found else k - 1 or None, len(found))
            children.setdefault(answers[k][0], []).append((bool(found) and answers[k][0] < k - 1, k))
            for level, x in passages(r[3]):
                if not level:
                    for s in [x, *re.split(r"\n\s*\n", x), *x.split("\n")]:
                        if norm(s):
                            first.setdefault(norm(s), k)
        order, todo = [], [1]
        while todo:
            k = todo.pop()
            order.append(k)
            todo += [c for _, c in sorted(children.get(k, []), reverse=True)]
        for position, k in enumerate(order, 1):
            text = "\n".join(x for level, x in passages(own[k - 1][3]) if not level)
            result[own[k - 1]] = (position, *answers[k], re.sub(r"^\s+|\s+$", "", re.sub(r"\n{3,}", "\n\n", text)))
    return result


def test_conversations_equal_a_plain_version(spark):
    rnd = random.Random(12)
    rows = []
    for conv in [*range(30), None]:
        said = []
        for turn in range(rnd.randrange(1, 14)):
            parts = []
            for _ in range(rnd.randrange(3)):
                if said and rnd.random() < 0.7:
                    quote = rnd.choice(said).split("\n")
                    quote = quote[: rnd.randrange(1, len(quote) + 1)]
                    if rnd.random() < 0.3:
                        parts.append("Ann wrote:" + rnd.choice(["", "\n"]))
                    parts.append("\n".join(rnd.choice(["> ", ">", ">> "]) * 1 + x.upper() for x in quote))
            parts.append("\n".join(f"line {rnd.randrange(6)} of {turn}" for _ in range(rnd.randrange(1, 4))))
            said.append(parts[-1])
            rows.append((conv, rnd.choice([turn, turn, turn, None]), rnd.choice(["user", "assistant"]), rnd.choice([None, ""]) if rnd.random() < 0.05 else "\n".join(parts)))
    rows += rows[:5]
    got = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "run": F.lit(2), "path": F.lit(3)})).collect()
    want = plain_conversations(rows)
    mine = sorted(((r.conv_id, r.turn, r.role, r.position, r.reply_to, r.quotes, r.text) for r in got), key=str)
    assert mine == sorted(((*key[:3], p, reply, n, text) for key, (p, reply, n, text) in want.items()), key=str)
    assert sum(r.quotes > 0 for r in got) > 60


def test_threads_stay_together_and_announcements_need_a_quote(spark):
    rows = [(1, 0, "u", "first"), (1, 1, "a", "second"), (1, 2, "u", "third"), (1, 3, "a", "fourth"), (1, 4, "u", "> first\nfifth"), (1, 5, "a", "> fifth\nsixth"), (1, 6, "u", "> second\nseventh"), (2, 0, "u", "My aunt wrote:\nDear all, hello.")]
    schema = "conv_id long, turn long, role string, text string"
    got = sorted(quotations.conversations(spark.createDataFrame(rows, schema)).collect(), key=lambda r: (r.conv_id, r.position))
    assert [r.turn for r in got if r.conv_id == 1] == [0, 1, 2, 3, 6, 4, 5] and got[-1].text == "My aunt wrote:\nDear all, hello."
    assert quotations.conversations(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 100_000
    got = quotations.conversations(spark.createDataFrame([(1, 0, "u", long), (1, 1, "a", f"> {long}\nyes")], schema)).collect()
    assert {(r.quotes, r.text) for r in got} == {(0, long.strip()), (1, "yes")}


# --- pipeline ----------------------------------------------------------------------------------------------------------
def test_pipeline_on_the_small_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    at, kept = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf).persist()
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= kept
        if name == "toxicity":
            assert not any(labels[i].toxic for i in now if i in labels)
            assert all(not labels[i].toxic for i in now & set(labels))
        if name == "n-gram Jaccard join":
            again = jaccard.jaccard_components(out, 5, 80)
            assert again.where("component_id <> doc_id").count() == 0
        if name == "benchmark decontamination":
            left = out.select(decontamination.contamination(F.col("text"), spark.read.parquet(f"{sf}/benchmark.parquet"))["n_hit"].alias("n"))
            assert out.columns == docs.columns and left.where("n > 0").count() == 0
        at, kept = out, now
    assert at.where("not exact").count() == 0


def test_near_duplicate_stage_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(3, a), (3, a), (3, b), (5, a), (None, a), (None, c), (None, c), (7, b + " more"), (4, None), (9, "one")]
    given = spark.createDataFrame([(i, text, "en", "s", 1) for i, text in rows], DOC)
    got = corpus_pipeline.near_duplicate_stage(spark, given, "")
    assert got.columns == given.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (3, b), (None, c), (4, None), (9, "one")], key=str)


def test_stages_of_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, names that clash, and empty tables."""
    import corpus_pipeline

    rows = odd(spark).withColumns({c: F.lit(9) for c in ("quality", "toxicity", "row", "hit", "_quality", "h", "f", "p", "component_id")})
    text = "this passage of the test has ten words and more"
    rows = rows.union(rows.where("doc_id = 3").withColumns({"doc_id": F.lit(8).cast("long"), "text": F.lit(f"before {text} after")}))
    for name, frame in (("labels", one(spark, [], "doc_id long, quality int, toxic int")), ("benchmark", one(spark, [("i", text), (None, None), ("e", "")], "item_id string, text string"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, str(tmp_path))
        kept[name] = sorted(str(r.doc_id) for r in got.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == rows.columns and got.where("quality <> 9 or hit <> 9").count() == 0
        assert stage(spark, rows.where("false"), str(tmp_path)).count() == 0
    everything = ["1", "2", "3", "4", "4", "5", "6", "7", "8", "None"]
    assert kept["quality classifier"] == ["4", "4", "5", "6", "7", "8", "None"]
    assert kept["toxicity"] == kept["benchmark decontamination"] == kept["SentencePiece encoding and decoding"] == everything
    assert kept["n-gram Jaccard join"] == ["1", "2", "3", "4", "5", "6", "7", "8"]
    cut = corpus_pipeline.decontamination_stage(spark, rows, str(tmp_path)).where("doc_id = 8").first()
    assert cut.text == "before  after" and cut.n_chars == 13


def test_decontamination_stage_keeps_one_worker_a_task(spark, tmp_path):
    """Finding and cutting in two functions kept twice as many Python workers beside every stage after; results are as of the two."""
    import corpus_pipeline

    text = "this passage of the test has ten words and more"
    other = "élan ÉLAN 漢字 a passage; of eleven words, that is cut as well"
    one(spark, [("i", text), ("j", other)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = [None, "", text, f"before, {text}. Between {other} (after)", f"{other} {text}", "no hit here", f"é {text[:-5]}!é"]
    rows = one(spark, [(i, t, "en", "s", len(t or "")) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.decontamination_stage(spark, rows, str(tmp_path))
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    for block_words in (500_000, 5):
        both = rows.select("doc_id", "text", decontamination.contamination(F.col("text"), items, block_words=block_words, cut=True).alias("r"))
        both = both.select("doc_id", "r.*", F.coalesce("r.left", "text").alias("a"), decontamination.without_spans(F.col("text"), F.col("r.spans")).alias("b")).collect()
        assert all(r.a == r.b and (r.left is None) == (r.n_hit == 0) for r in both) and sum(r.n_hit > 0 for r in both) == 3
    assert {r.doc_id: r.text for r in cut.collect()} == {r.doc_id: r.a for r in both if not 0 < r.n_hit == r.n_words}


def test_operators_of_empty_tables_and_clashing_names(spark, docs):
    """What the tests above leave out."""
    none = one(spark, [], DOC)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(toxicity.labelled_sample(none, labels, "toxic"))
    assert none.select(toxicity.toxicity(F.col("text"), model, spark).alias("r")).count() == 0 and model.trees is None
    languages = language.train(docs)
    assert none.select(language.language(F.col("text"), languages, spark).alias("r")).count() == 0
    both = language.Model(["a", "b"], languages.idf, np.concatenate([languages.centroids[:1]] * 2), np.array([0, 1]), np.zeros(2))
    assert both.predict(["some text"]).lang_pred[0] == "a"  # a tie goes to the first by name
    assert none.select(pieces.round_trip(F.col("text"), queries.PIECES).alias("r")).count() == 0
    with pytest.raises(ValueError):
        pieces.vocabulary(queries.PIECES).decode([-1])
    items = one(spark, [], "item_id string, text string")
    found = odd(spark).withColumns({"n_words": F.lit(1), "spans": F.lit(2)}).select("spans", decontamination.contamination(F.col("text"), items).alias("c")).collect()
    assert len(found) == 9 and all(r.c.n_hit == 0 and r.spans == 2 for r in found)
    assert none.select(decontamination.contamination(F.col("text"), spark.read.parquet(f"{SF}/benchmark.parquet")).alias("c")).count() == 0
    assert jaccard.jaccard_components(odd(spark).withColumns({"cid": F.lit(1), "gid": F.lit(2), "sig": F.lit(3)})).count() == 9


def test_language_equals_a_plain_version(spark, docs):
    """Counts of n-grams, weights and cosines by dictionaries."""
    model = language.train(docs.where(fold(4) != 2))
    texts = [r.text for r in docs.limit(25).collect()]
    got = model.predict(texts)
    for i, text in enumerate(texts):
        s, count = f" {language.letters(text)} ", Counter()
        for n in language.ORDERS:
            for k in range(len(s) - n + 1):
                h = 0
                for c in s[k : k + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                count[((h + n) * 0xBF58476D1CE4E5B9 % 2**64) >> 51] += 1
        v = {k: math.log1p(c) * model.idf[k] for k, c in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * centre[k] for k, x in v.items()) / norm for centre in model.centroids]
        best = max(range(len(cosine)), key=lambda j: cosine[j])
        assert got.lang_pred[i] == model.languages[model.owner[best]] and abs(got.score[i] - cosine[best]) < 1e-4
    assert (model.predict(texts[::-1]).score[::-1].to_numpy() - got.score.to_numpy()).max() < 1e-6
