"""Personal data: the base spans against plain patterns, the trained part on held-out forms, odd and long texts."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, queries

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
SF = "/root/testdata/sf0.001"


def checksum(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), kind == 2 and 16 <= len(digits) <= 19 and checksum(digits), kind == 3 and 8 <= len(digits) <= 15)[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    bits = ["a", ".", "@", "-", "1", "23", "4", "+", " ", "(", ")", "é", "%", "255", "300", ".1", "4111111111111111", "@b.c", "𝔄", "\n"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain(text), text
    text = "x" * 1000 + "@b.cc " + "y." * 300 + "@q.rr" + "z@" * 50 + "w.w"
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 500_000 + "@", "@" * 300_000, "1" * 500_000, "1 " * 300_000, "1." * 300_000, "+1 " * 200_000, "+1" + " " * 300_000, "a@" * 200_000, "[at] " * 100_000, " (at) " * 3 + "a dot " * 100_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.perf_counter()
    pii.base_spans(text), pii.proposed(text)
    assert time.perf_counter() - began < 10


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), max_documents=800)


FORMS = {
    "email": ["write to joe [at] mail dot example dot com now", "write to ann at host dot example dot org now", "kontakt: max [at] post.example.de bitte"],
    "ip": ["server 10[.]2[.]3[.]4 is down", "the host 2001:db8:0:1:22:1 answers"],
    "card": ["my card is 4111.1111.1111.1111 ok", "visa 4111/1111/1111/1111 paid"],
    "phone": ["please call 279-555-0024 today", "tel (279) 555-0024 or mail", "phone 001 279 555 0024 at night"],
}


def test_spans_of_other_forms_are_added_and_clean_numbers_left(model):
    score = model.scorer()
    hit = [any(pii.KINDS[s["kind"]] == kind and not s["base"] for s in score([t]).spans[0]) for kind, texts in FORMS.items() for t in texts]
    assert sum(hit) >= len(hit) - 1
    clean = ["on 2024-01-05 we met", "ISBN 978-3-1234-5678-9", "order 1234567890", "at 12:30:45", "see 1990-1995", "population 1 234 567", "number 4111 1111 1111 1112", "meet at noon. then", "section 1.2.3", "apples at the market dot"]
    assert [t for t in clean if score([t]).spans[0]] == []


def test_scores_tell_held_out_examples_apart(spark, model):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike("[0-9@]")).select("text").collect()]
    rows = [x for t in texts for x in pii.examples(t)]
    for kind, (trees, _, _) in model.parts.items():
        own = [r for r in rows if r[0] == kind]
        raw = trees.raw(__import__("numpy").array([r[2] for r in own]))
        assert sum((x > 0) == (r[1] == 1) for x, r in zip(raw, own, strict=True)) / len(own) > 0.97, pii.KINDS[kind]


def test_odd_rows(spark, model):
    rows = [(1, None), (1, ""), (None, "joe@a.b and +1 (279) 555-0024"), (None, "joe@a.b and +1 (279) 555-0024"), (2, "𝔄𝔅 x@y.zz, é.1@y.zz"), (3, "word " * 50_000 + "1.2.3.4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as score", "2 as kind")
    got = [[(s.kind, s.start, s.end) for s in r.s if s.base] for r in docs.select(pii.personal_data(F.col("text"), model, spark)["spans"].alias("s")).collect()]
    assert sorted(map(str, got)) == sorted(str(plain(t)) for _, t in rows)
    none = pii.train(docs.limit(0))
    assert none.parts == {} and none.scorer()([None, "a@b.c"]).spans.map(len).tolist() == [0, 1]
    assert docs.limit(0).select(pii.personal_data(F.col("text"), none, spark)).count() == 0


def test_redaction_covers_overlapping_spans(spark, model):
    docs = spark.createDataFrame([(1, "x [at] y dot com, mail a.b@c.de or 10.0.0.1!"), (2, None)], "doc_id long, text string")
    found = docs.select("text", pii.personal_data(F.col("text"), model, spark)["spans"].alias("s")).select(pii.redacted("text", "s").alias("r")).collect()
    assert found[0].r.endswith("mail [email] or [ip]!") and found[1].r is None


def test_the_query_has_the_base_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in base) for k in range(4))
        printed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(printed).encode()).hexdigest()
        assert set(printed) <= set(r.spans.split(",")) | {""} and len([s for s in r.spans.split(",") if s]) == len(base) + r.n_added
