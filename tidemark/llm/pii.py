"""Personal data: generators propose spans with high recall, boosted trees score them, calibrated thresholds select what is redacted.

Four strict patterns give the base spans, which always stay. Beside them wide generators propose spans that overlap each other and the
base: addresses with letters of any script, spelled-out or spaced ("name [at] host dot org"), numbers with other separators, phones without
a plus, addresses of six groups or with guarded dots. Trees of their own for each kind score a span by its format (digits, groups, separators, check
digit, ranges) and its context (words before it, neighbouring characters). They learn from a bounded sample of documents: spans that a strict pattern
confirms and rewritings of these in the forms that the generators cover are positive; spans that fail their kind's check, or belong to another kind, rewritings of
these, and dates, versions, times and counters put into the same contexts are negative. Scores are calibrated by isotonic regression on predictions out of
fold, and the threshold of a kind is the least at which the spans above it are right in ``PRECISION`` of all cases.

Defined results: a null or empty text has no spans. Positions are code points, ends exclusive. Added spans never lie within a base span, never overlap one of another kind, and of
those of one kind that overlap the best scored stays (then the longest, then the first). Equal texts have equal spans. Without a confirmed span in the sample nothing
is added. Rows that repeat an id are judged each by itself. All patterns take time in proportion to the text.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.texts import over_texts, small_batches, stored, tidied
from tidemark.llm.toxicity import Trees, boost, isotonic

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
#: Documents and, of each, confirmed and refused spans to learn from.
MAX_DOCUMENTS, MAX_EXAMPLES = 2000, 12
SPANS = "array<struct<kind:int,start:int,end:int,score:double,base:boolean>>"

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = "".join(c for c in map(chr, range(128)) if re.match(r"[A-Za-z0-9._%+-]", c))
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SPACES = " \u00a0\u2009"
DIGIT = re.compile(r"[0-9]")
NUMBERS = re.compile(r"[0-9]+")
AT = r"(?:[ ]?[\[({<][ ]?(?:at|arroba|@)[ ]?[\])}>][ ]?|[ ](?:at|arroba|@)[ ])"
DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|punkt|punto|\.)[ ]?[\])}>][ ]?|[ ](?:dot|punkt|punto)[ ]|\.)"
SPELLED = re.compile(rf"(?<![\w.%+-])[\w%+-]{{1,64}}(?:(?:\.|{DOT})[\w%+-]{{1,64}}){{0,3}}{AT}[\w-]{{1,63}}(?:{DOT}[\w-]{{1,63}}){{1,4}}", re.IGNORECASE)
MAYBE_SPELLED = re.compile(r"[\[({<][ ]?(?:at|arroba|@)[ ]?[\])}>]| @ | (?:at|arroba) [\w-]{1,63}(?: (?:dot|punkt|punto) |[ ]?[\[({<])", re.IGNORECASE)
WIDE = re.compile(r"(?<![^\s<>()\[\]{}\"',;:@|=])[^\s<>()\[\]{}\"',;:@|=]{1,80}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,6}")
WIDE_IP = re.compile(r"(?<![\w.:])(?:[0-9]{1,4}(?:[ ]?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)[ ]?[0-9]{1,4}){2,5}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:])")
WIDE_CARD = re.compile(rf"(?<![\w.])[0-9](?:[./_\u2011{SPACES}-]{{0,2}}[0-9]){{11,22}}(?!\w)")
WIDE_PHONE = re.compile(rf"(?<![\w.+])(?:\+ ?|\()?[0-9](?:[()./\u2011{SPACES}-]{{0,3}}[0-9]){{6,15}}(?!\w)")

#: Words that stand before such data, by kind, and before other numbers, in the languages in use.
CUES = (
    "email e-mail mail mailto contact correo courriel adresse write kontakt".split(),
    "ip host server address router gateway proxy client login".split(),
    "card visa mastercard amex credit debit karte kreditkarte carte tarjeta payment".split(),
    "phone tel telephone call mobile cell fax whatsapp telefon handy anruf téléphone portable teléfono móvil llamar sms".split(),
    "version release section chapter page isbn issn order invoice item ref id no nr number date year seit since row serial token".split(),
)
CUE = {w: k for k, ws in enumerate(CUES) for w in ws}
WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    twice = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(NUMBERS.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind and start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start, look = at, 256
        while start > end and len(part := text[max(end, start - look) : start]) > (left := len(part.rstrip(LOCAL))):
            start -= len(part) - left
            if left:
                break
            look *= 2
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() <= 37 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def proposed(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the generators."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in WIDE.finditer(text)]
    if MAYBE_SPELLED.search(text):
        out += [(0, *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        out += [(k, *m.span()) for k, p in ((1, WIDE_IP), (2, WIDE_CARD), (3, WIDE_PHONE)) for m in p.finditer(text)]
    return out


def features(kind: int, text: str, start: int, end: int) -> list[float]:
    """Format of the span and its context."""
    span = text[start:end]
    before, after = text[max(0, start - 48) : start], text[end : end + 2]
    groups = NUMBERS.findall(span)
    d = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    letters = [c for c in span if c.isalpha()]
    separators = re.sub(r"[\w]", "", span)
    cues = [CUE.get(w.lower(), -1) for w in WORD.findall(before)[-5:]]
    labels = re.split(r"[.\s\[\](){}<>]+|\bdot\b|\bpunkt\b|\bpunto\b", span)
    last = [x for x in labels if x][-1:] or [""]
    low = span.lower()
    return [
        len(span), len(d), len(letters), len(groups), min(sizes), max(sizes), float(sizes[0]), float(sizes[-1]), float(len(set(sizes)) == 1), float(bool(d) and luhn(d)), float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        *(separators.count(c) for c in ".-/:@+"), sum(separators.count(c) for c in SPACES), sum(separators.count(c) for c in "()"), sum(separators.count(c) for c in "[]{}<>"), float(len(set(separators))),
        float(span.startswith("+")), float(span.startswith("00")), float(len(re.findall(r"\bat\b|\barroba\b|@", low))), float(len(re.findall(r"\bdot\b|\bpunkt\b|\bpunto\b", low))), float(len(last[0])), float(last[0].isascii() and last[0].isalpha()),
        float(any(ord(c) > 127 for c in letters)), float(sum(c in "abcdefABCDEF" for c in letters) == len(letters)), float(sizes[0] == 4 and 1900 <= int(groups[0]) < 2100) if groups else 0.0, float(len(groups) > 1 and 0 < int(groups[1][:9]) <= 12),
        float(kind in cues), float(any(c >= 0 and c not in (kind, 4) for c in cues)), float(4 in cues), float(before[-1:] in "=#$/\\_&" and before != ""), float(before[-1:].isalnum()), float(after[:1] in "%/_€$" and after != ""), float(after[:1].isalnum()),
    ]


def rewritten(kind: int, span: str, rng: random.Random) -> str:
    """The same datum in a form that the strict patterns don't take but the generators do."""
    d = digits_of(span)
    if kind == 0:
        local, _, host = span.partition("@")
        at, dot = rng.choice([(" [at] ", "."), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", "."), (" arroba ", " punto "), (" [at] ", " punkt ")])
        return rng.choice([local.strip(".%+-") or "x", "é" + local]) + at + host.replace(".", dot) if at != "@" else span
    if kind == 1:
        if rng.random() < 0.4:
            parts = [f"{int(x) * 257:x}" for x in span.split(".")]
            return ":".join(["2001", "db8", *parts, *(f"{rng.randrange(65536):x}" for _ in range(2))])
        return span.replace(".", rng.choice(["[.]", "(.)", " . ", "[dot]"]))
    if kind == 2:
        sep = rng.choice([".", "/", "_", "\u00a0", " - ", "  ", "\u2011"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    own, area, rest = d[: max(1, len(d) - 10)], d[-10:-7], d[-7:]
    form = rng.randrange(6)
    return ("00" + f"{own} {area} {rest[:3]} {rest[3:]}", f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"+{own}/{area}/{rest}", f"({own}{area}) {rest}")[form]


def other(kind: int, rng: random.Random) -> tuple[str, str]:
    """(words before, something of the kind's look that is nobody's datum)."""
    n = rng.randrange
    cue = rng.choice(["", "", rng.choice(CUES[4]) + " "])
    if kind == 0:
        return "", rng.choice([f"look at page dot{n(9)}", f"a at b{n(9)}", "meet at noon. then", f"@ {n(99)} . {n(99)}", f"price @ {n(99)}.{n(9)}0"])
    if kind == 1:
        return cue, rng.choice([f"{n(20)}.{n(30)}.{n(40)}", f"{n(24):02}:{n(60):02}:{n(60):02}", f"{n(31)}.{n(12)}.20{n(30):02}", f"{n(9)}.{n(9)}.{n(9)}.{256 + n(700)}", f"{n(9)}.{n(9)}.{n(9)}.{n(9)}.{n(9)}", ".".join(str(n(9000) + 999) for _ in range(n(4) + 2))])
    if kind == 2:
        return cue, "".join(str(n(10)) for _ in range(n(8) + 12))
    return cue, rng.choice([f"20{n(30):02}-{n(12) + 1:02}-{n(28) + 1:02}", f"{n(28) + 1:02}.{n(12) + 1:02}.20{n(30):02}", f"978-{n(10)}-{n(10000):04}-{n(10000):04}-{n(10)}", f"{1900 + n(99)}-{1900 + n(99)}", "".join(str(n(10)) for _ in range(n(8) + 7)), f"{n(1000)} {n(1000):03} {n(1000):03}", f"{n(100)}.{n(1000):03}.{n(1000):03}"])


def examples(text: str) -> list[tuple[int, int, list[float]]]:
    """(kind, label, features) that a document teaches."""
    rng = random.Random(zlib.crc32(text.encode(errors="replace")))
    base = base_spans(text)[: 4 * MAX_EXAMPLES]
    out: list[tuple[int, int, list[float]]] = []

    def put(kind: int, label: int, start: int, end: int, new: str, before: str = "") -> None:
        left, right = text[max(0, start - 60) : start] + before, text[end : end + 4]
        out.append((kind, label, features(kind, left + new + right, len(left), len(left) + len(new))))

    for kind, a, b in base[:MAX_EXAMPLES]:
        put(kind, 1, a, b, text[a:b])
        for _ in range(3):
            before = rng.choice(["", "", rng.choice(CUES[kind]) + rng.choice([": ", " "])])
            put(kind, 1, a, b, rewritten(kind, text[a:b], rng), before)
            before, new = other(kind, rng)
            put(kind, 0, a, b, new, before)
    for kind, a, b in proposed(text)[:MAX_EXAMPLES]:
        near = [(k, s, e) for k, s, e in base if s < b and a < e]
        same = [x for x in near if x[0] == kind]
        if same:
            if any(a <= s and e <= b for _, s, e in same):
                put(kind, 1, a, b, text[a:b])
        elif near or (kind == 2 and not luhn(digits_of(text[a:b]))) or (kind == 1 and "." in text[a:b] and not (len(g := NUMBERS.findall(text[a:b])) == 4 and all(int(x) <= 255 for x in g))):
            put(kind, 0, a, b, text[a:b])
            if kind == 2 and not near:
                put(kind, 0, a, b, rewritten(2, text[a:b], rng), rng.choice(["", rng.choice(CUES[2]) + " "]))
    return out


class Model:
    """Trees, knots of the calibration and threshold of each kind that has any."""

    def __init__(self, parts: dict[int, tuple[Trees, tuple[np.ndarray, np.ndarray], float]]) -> None:
        self.parts = parts

    def scorer(self):
        def found(texts: list[str | None]) -> pd.DataFrame:
            base = [base_spans(t or "") for t in texts]
            wide: dict[int, list[tuple[int, int, int]]] = {k: [] for k in self.parts}
            for i, (t, own) in enumerate(zip(texts, base, strict=True)):
                for kind, a, b in proposed(t or "") if self.parts else ():
                    if kind in wide and not any(s < b and a < e and (k != kind or s <= a and b <= e) for k, s, e in own):
                        wide[kind].append((i, a, b))
            added: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
            for kind, spans in wide.items():
                if spans:
                    trees, knots, least = self.parts[kind]
                    p = np.interp(trees.raw(np.array([features(kind, texts[i], a, b) for i, a, b in spans])), *knots)
                    for (i, a, b), x in zip(spans, p.tolist(), strict=True):
                        if x >= least:
                            added[i].append((x, kind, a, b))
            out = []
            for own, more in zip(base, added, strict=True):
                spans = [(k, a, b, 1.0, True) for k, a, b in own]
                taken: dict[int, list[tuple[int, int]]] = {}
                for x, kind, a, b in sorted(more, key=lambda m: (-m[0], m[2] - m[3], m[2])):
                    if not any(s < b and a < e for s, e in taken.get(kind, ())):
                        taken.setdefault(kind, []).append((a, b))
                        spans.append((kind, a, b, x, False))
                out.append([dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in sorted(spans)])
            return pd.DataFrame({"spans": pd.Series(out, dtype=object)})

        return found


def train(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, folds: int = 3) -> Model:
    """Learns from at most ``max_documents`` distinct texts that hold a digit or an @, lowest hash first."""
    small_batches(docs.sparkSession)
    texts = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("order"))
    chosen = stored(texts.select("order").distinct().orderBy("order").limit(max_documents))
    sample = texts.join(F.broadcast(chosen), "order").groupBy("order").agg(F.min("text").alias("text"))

    @tidied
    def taught(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(o, *x) for o, t in zip(part.order, part.text, strict=True) for x in examples(t)]
            yield pd.DataFrame(rows, columns=["order", "kind", "label", "x"])

    rows = sample.mapInPandas(taught, "order long, kind int, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.order, r.kind, r.label, r.x))
    parts = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r.kind == kind]
        y = np.array([r.label for r in own], float)
        if not 10 <= y.sum() <= len(y) - 10:
            continue
        x, fold = np.array([r.x for r in own]), np.array([r.order % folds for r in own])
        p = np.zeros(len(y))
        for k in range(folds):
            if (fold == k).any() and (fold != k).any():
                p[fold == k] = boost(x[fold != k], y[fold != k], rounds=40).raw(x[fold == k])
        knots = isotonic(p, y)
        calibrated = np.interp(p, *knots)
        order = np.argsort(-calibrated, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero((right >= PRECISION) & (np.append(calibrated[order][1:], -1) < calibrated[order]))
        if len(good):
            parts[kind] = (boost(x, y, rounds=40), knots, max(0.5, float(calibrated[order][good[-1]])))
    return Model(parts)


def personal_data(column: Column, model: Model, spark) -> Column:
    """A struct (spans: ``SPANS``, by kind and start) for each text."""
    shared = spark.sparkContext.broadcast(model)
    return over_texts(column, lambda: shared.value.scorer(), f"spans {SPANS}")


def printed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@F.pandas_udf(StringType())
def redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The texts with each run of overlapping spans replaced by its first span's kind in brackets."""
    out = []
    for text, own in zip(texts, spans, strict=True):
        if text is None or own is None:
            out.append(text)
            continue
        parts, at = [], 0
        for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
            if s["end"] > at:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"[{KINDS[s['kind']]}]"]
                at = s["end"]
        out.append("".join(parts) + text[at:])
    return pd.Series(out, dtype=object)
