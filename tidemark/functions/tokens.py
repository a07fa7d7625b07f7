"""Tokens for lexical ranking, token counts and token windows, as columns."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SETTINGS
from tidemark.functions.text import CJK, latin_fold, nfkc_casefold

#: The default tokenizer: a run of ASCII letters, digits and underscores, or any other single character that is no space.
TOKEN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
SENTINEL = "\x01"


def lexical_tokens(text: Column, latin: bool = False) -> Column:
    """Latin runs as they are; for a CJK run its characters, its neighbouring pairs and, from three characters on, itself.

    ``latin``: the text is known to be Latin-1, so folding needs no Python.
    """
    folded = latin_fold(text) if latin else nfkc_casefold(text)
    runs = F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(f"[a-z0-9_]+|[{CJK}]+"), F.lit(0))

    def parts(run: Column) -> Column:
        n = F.length(run)
        chars = F.split(run, "")
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        whole = F.when(n > 2, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(chars, pairs, whole)).otherwise(F.array(run))

    # most texts have no CJK run, so their runs need no look each
    return F.when(folded.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, parts))).otherwise(runs)


_RUN = re.compile(f"[a-z0-9_]+|[{CJK}]+")
COUNTS = "struct<dl:int,terms:array<struct<term:string,tf:bigint>>>"


def run_tokens(folded: str) -> list[str]:
    """``lexical_tokens`` of a folded text."""
    runs = _RUN.findall(folded)
    if folded.isascii():
        return runs
    out = []
    for run in runs:
        if run.isascii():
            out.append(run)
        else:
            out += [*run, *(run[i : i + 2] for i in range(len(run) - 1)), *([run] if len(run) > 2 else [])]
    return out


#: Texts whose tokens a task holds as objects at once.
HELD = 256


def folded(text: str | None, latin: bool) -> str:
    """What ``run_tokens`` takes; with ``latin`` the text is folded already."""
    return "" if text is None else text if latin else text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def term_counts(text: Column, latin: bool = False) -> Column:
    """struct<dl, terms: array<struct<term, tf>>>: how many of ``lexical_tokens`` a text has and how often each distinct one, counted where the row is, so without a shuffle."""

    def part(texts: pa.Array) -> pa.Array:
        lengths, ends, terms, tf = [], [0], [], []
        for x in texts.to_pylist():
            tokens = run_tokens(folded(x, latin))
            found = Counter(tokens)
            lengths.append(len(tokens))
            terms += found.keys()
            tf += found.values()
            ends.append(len(terms))
        entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int64())], ["term", "tf"])
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["dl", "terms"])

    @F.arrow_udf(COUNTS)
    def counted(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(texts[i : i + HELD]) for i in range(0, max(1, len(texts)), HELD)])

    return counted(latin_fold(text) if latin else text)


def counted_parts(batches: Iterable[pa.RecordBatch], of: Callable[[str], int | None], latin: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches with dl, ids and tf in place of their last column, a (folded, if ``latin``) text: ``HELD`` texts at a time, and only numbers of each."""
    for batch in batches:
        for first in range(0, batch.num_rows, HELD):
            part = batch.slice(first, HELD)
            lengths, ends, ids, tf = [], [0], [], []
            for x in part.column(part.num_columns - 1).to_pylist():
                tokens = run_tokens(folded(x, latin))
                for term, n in Counter(tokens).items():
                    if (i := of(term)) is not None:
                        ids.append(i)
                        tf.append(n)
                lengths.append(len(tokens))
                ends.append(len(ids))
            upto, kind = pa.array(ends, pa.int32()), pa.int32()
            found = [pa.array(lengths, kind), pa.ListArray.from_arrays(upto, pa.array(ids, kind)), pa.ListArray.from_arrays(upto, pa.array(tf, kind))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=[*part.schema.names[:-1], "dl", "ids", "tf"])


def known_counts(rows: DataFrame, keep: tuple[str, ...], text: Column, numbers: Broadcast, latin: bool = False) -> DataFrame:
    """The columns to keep of ``rows``, and dl, ids and tf of a text: how many of ``lexical_tokens`` it has, and the numbers and counts of those distinct ones that ``numbers`` (a dictionary) has."""
    kept = rows.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    texts = rows.select(*keep, (latin_fold(text) if latin else text).alias("_text"))
    return texts.mapInArrow(lambda batches: counted_parts(batches, numbers.value.get, latin), f"{schema}, dl int, ids array<int>, tf array<int>")


#: Chunks whose postings of a term are one row; their numbers within it are of 16 bits.
BLOCK = 1 << 14
PACKED = "term string, block long, at array<smallint>, dl array<int>, tf array<int>"


def packed_postings(texts: DataFrame, latin: bool = False) -> DataFrame:
    """term, block, at, dl and tf of ``texts`` (no, text): of each term in each block of ``BLOCK`` numbers the texts that have it, as number within the block, tokens of the text and how often."""
    rows = texts.select("no", (latin_fold(F.col("text")) if latin else F.col("text")).alias("_text"))
    return rows.mapInArrow(lambda batches: packed_parts(batches, latin), PACKED)


def packed_parts(batches: Iterable[pa.RecordBatch], latin: bool = False, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """A block's postings of some ``rows`` terms each, from batches of (no, text); what is held is one block's postings, as numbers."""
    block, words, terms, counts, places = None, {}, array("i"), array("i"), []

    def closed() -> Iterator[pa.RecordBatch]:
        term, tf = np.frombuffer(terms, np.int32), np.frombuffer(counts, np.int32)
        n, at, dl = np.array(places, np.int64).reshape(-1, 3).T
        held = (at.astype(np.int16).repeat(n), dl.astype(np.int32).repeat(n), tf)
        order, ends, names = np.argsort(term, kind="stable"), np.r_[0, np.cumsum(np.bincount(term, minlength=len(words)))], list(words)
        for first in range(0, len(names), rows):
            upto = ends[first : first + rows + 1]
            part, offsets = order[upto[0] : upto[-1]], pa.array(upto - upto[0], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[part])) for x in held]
            own = names[first : first + rows]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([block] * len(own), pa.int64()), *lists], names=["term", "block", "at", "dl", "tf"])

    for batch in batches:
        for first in range(0, batch.num_rows, HELD):
            part = batch.slice(first, HELD)
            for no, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if no // BLOCK != block:
                    yield from closed()
                    block, words, terms, counts, places = no // BLOCK, {}, array("i"), array("i"), []
                tokens = run_tokens(folded(x, latin))
                found = Counter(tokens)
                terms.extend([words.setdefault(w, len(words)) for w in found])
                counts.extend(found.values())
                places.append((len(found), no % BLOCK, len(tokens)))
    yield from closed()


def token_count(text: Column) -> Column:
    """Default tokens with the special ones."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)) + SETTINGS.special_tokens


def context_cost(text: Column, known: Column) -> Column:
    """A chunk's known token count, else CJK characters plus Latin runs and non-ASCII characters (which counts CJK twice), one at least."""
    text = F.coalesce(text, F.lit(""))
    counted = F.regexp_count(text, F.lit(f"[{CJK}]")) + F.regexp_count(text, F.lit(r"[a-zA-Z0-9_]+|[^\x00-\x7f]"))
    return F.coalesce(F.when(known > 0, known), F.greatest(F.lit(1), counted))


_PART = re.compile(r"(?:[A-Za-z0-9_]+|[^ \t\n\x0b\f\rA-Za-z0-9_])[ \t\n\x0b\f\r]*")
_MARK = re.compile(r"([A-Za-z0-9_]+|[^ \t\n\x0b\f\rA-Za-z0-9_])")


def counted_windows(text: str, limit: int, overlap: int) -> list[tuple[str, int]]:
    """The stripped text whole if it has at most ``limit`` tokens, else overlapping windows of tokens with the characters between them; and how many tokens each has."""
    payload = limit - SETTINGS.special_tokens
    step = payload - min(overlap, payload - 1)
    if not (whole := text.strip()):
        return []
    plain = SENTINEL not in whole
    parts = _PART.findall(whole) if plain else [x for x in _MARK.sub(SENTINEL + r"\1", whole).split(SENTINEL) if x]
    if len(parts) <= payload:
        return [(whole, len(parts) if plain else len(_MARK.findall(whole)))]
    last, out = -(-(len(parts) - payload) // step), []
    for i in range(last + 1):
        own = parts[i * step : i * step + payload]
        joined = "".join(own)
        window = joined.strip()
        # a part is a token unless that is white space of another kind at an end
        out.append((window, len(own) if plain and len(window) == len(joined.strip(" \t\n\x0b\f\r")) else len(_MARK.findall(window))))
    return out


def token_windows(text: str, limit: int, overlap: int) -> list[str]:
    return [w for w, _ in counted_windows(text, limit, overlap)]


def unit_windows(texts: Column, limit: int, overlap: int) -> Column:
    """array<struct<unit, no, text, tokens>>: the windows of each of an array's texts, with the place of the text in the array, of the window in the text, and its ``token_count``."""

    @F.arrow_udf("array<struct<unit:int,no:int,text:string,tokens:int>>")
    def cut(rows: pa.Array) -> pa.Array:
        ends, units, places, out, sizes = [0], [], [], [], []
        for row in rows.to_pylist():
            for unit, text in enumerate(row or []):
                found = counted_windows(text or "", limit, overlap)
                units += [unit] * len(found)
                places += range(len(found))
                out += [x for x, _ in found]
                sizes += [n + SETTINGS.special_tokens for _, n in found]
            ends.append(len(out))
        entries = pa.StructArray.from_arrays([pa.array(units, pa.int32()), pa.array(places, pa.int32()), pa.array(out, pa.string()), pa.array(sizes, pa.int32())], ["unit", "no", "text", "tokens"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    return cut(texts)


def windows(text: Column, limit: int = SETTINGS.target_tokens, overlap: int = SETTINGS.overlap_tokens) -> Column:
    """``token_windows`` of a text, in Python: a sequence of several thousand tokens is slow as a column of lambdas."""
    return F.transform(unit_windows(F.array(text), limit, overlap), lambda w: w["text"])


def character_parts(text: str | None, limit: int, overlap: int) -> list[str]:
    """The longest parts of up to ``limit`` tokens (special ones counted), cut at any character; each begins ``overlap`` characters before the end of the one before."""
    text, payload = text or "", max(1, limit - SETTINGS.special_tokens)
    token, out, start = re.compile(TOKEN), [], 0
    while start < len(text):
        begins = [m.start() for _, m in zip(range(payload + 1), token.finditer(text, start), strict=False)]
        end = len(text) if len(begins) <= payload else begins[payload]
        if part := text[start:end].strip():
            out.append(part)
        if end == len(text):
            break
        start = max(start + 1, end - max(0, overlap))
    return out


def character_windows(text: Column, limit: int, overlap: int) -> Column:
    """``character_parts`` as a column: for tokenizers that don't say where their tokens stand."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([character_parts(x, limit, overlap) for x in texts], dtype=object)

    return cut(text)
