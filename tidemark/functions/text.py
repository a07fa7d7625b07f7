"""Scalar text functions as columns. Built-ins unless a docstring says otherwise."""

from __future__ import annotations

import html
import ntpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------------------------------
KNOWN_SUFFIXES = r"\.(?:pdf|docx?|md|txt|html?|json|ya?ml|toml|py|sql)"
ENTITY_EDGES = " ：:，,。.；;（）()[]【】"
CONNECTIVES = "其中|例如|如|以及|和|与|及"
MARKERS = ("当前资料依据不足", "资料依据不足", "未能生成有证据支持", "insufficient evidence")
UNNAMED = "未命名来源"
NO_NAME = "已导入资料"
NEW_CHAT = "新对话"
CJK = "㐀-䶿一-鿿"
# -------------------------------------------------------------------------------------------------------------------
#: What Python's str.strip() takes off, as a Java character class.
BLANKS = r"\s\x1c-\x1f\x85\xa0  -     　"


#: Decimal digits of other scripts that people write numbers with, in the order of 0 to 9.
DIGITS = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९"


#: The same as characters, for which only the ends of a text are looked at.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def filled(x: Column) -> Column:
    """Whether a text has anything but white space."""
    return F.coalesce(x, F.lit("")).rlike(f"[^{BLANKS}]")


def first_filled(*xs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(x != "", x) for x in xs))


@F.pandas_udf(T.StringType())
def nfkc_casefold(x: pd.Series) -> pd.Series:
    """Neither engine function exists built in."""
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility characters in one form: meant for catalogs."""
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def latin_fold(x: Column) -> Column:
    """The same as nfkc_casefold for texts of ASCII letters and accented Latin-1 letters, without leaving the JVM."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else html.unescape(v))


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def unescape_closed(x: pd.Series) -> pd.Series:
    """References that end in a semicolon; one that a page breaks off in stays as it stands."""
    return x.map(lambda v: None if v is None else _CLOSED.sub(lambda m: html.unescape(m.group()), v))


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<[^>]+>", " ")


def html_to_text(x: Column, decode=unescape) -> Column:
    """Markup to text: scripts and styles go, line ends for breaks and block ends, other tags to spaces, references decoded."""
    x = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"</(p|div|h[1-6]|li|tr)>", "\n")
    x = decode(F.regexp_replace(x, r"<[^>]+>", " "))
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def docx_text(xml: Column) -> Column:
    """The text of a word-processor document part; paragraphs end lines."""
    runs = F.regexp_extract_all(F.replace(xml, F.lit("</w:p>"), F.lit("\n")), F.lit(r"(?s)<w:t[^>]*>(.*?)</w:t>"), F.lit(1))
    return unescape(F.array_join(F.transform(runs, strip_tags), "\n"))


def normalized_name(x: Column) -> Column:
    folded = nfkc_casefold(strip(x))
    return F.regexp_replace(F.regexp_replace(folded, rf"{KNOWN_SUFFIXES}[{BLANKS}]*$", ""), r"[^\p{L}\p{N}]", "")


def latin_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(latin_fold(F.trim(x)), rf"{KNOWN_SUFFIXES}\s*$", ""), r"[^\p{L}\p{N}]", "")


@F.pandas_udf(T.StringType())
def _identity(path: pd.Series) -> pd.Series:
    fold = lambda p: ntpath.normcase(ntpath.normpath(unicodedata.normalize("NFKC", p).strip())).replace("\\", "/")
    return path.map(lambda p: None if p is None else fold(p))


def source_identity(kind: Column, path: Column) -> Column:
    """Type and path in one form, whatever the slashes and dots: meant for catalogs, not for every row of a corpus."""
    return F.concat(F.lower(kind), F.lit(":"), _identity(path))


def remove_links(x: Column) -> Column:
    return F.regexp_replace(x, r"https?://\S+|www\.\S+", "")


def clean_text(x: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), f"[{BLANKS}]+", " "))


def full_text(x: Column) -> Column:
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t\f\x0b]+", " "), r"\n{3,}", "\n\n"))


def compact(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), f"[{BLANKS}？?。！!，,：:；;“”\"'`]+", ""))


def trim_sentence(x: Column, limit: int) -> Column:
    x = clean_text(x)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, limit)), F.lit("...")))


def inferred_title(name: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"^\d+\s*", "")
    return first_filled(F.trim(F.translate(stem, "_-", "  ")), F.lit(NO_NAME))


def pieces(x: Column, width: int) -> Column:
    """The text in slices of ``width`` characters."""
    n = F.ceil(F.length(x) / width).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(x, i * width + 1, F.lit(width)))
    return F.when(F.length(x) > 0, cut).otherwise(F.array().cast("array<string>"))


def without_code_header(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"^文件:\s*[^\n]+\n+", "")


def json_payload(x: Column) -> Column:
    """The JSON object in an answer, from the first brace to the last, or null."""
    found = F.regexp_extract(F.regexp_replace(x, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.when(found != "", found)).isNotNull(), found)


def clean_entity(x: Column) -> Column:
    x = F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), f"[{BLANKS}]+", " "), F.lit(ENTITY_EDGES))
    return strip(F.substring(F.regexp_replace(x, f"^({CONNECTIVES})", ""), 1, 50))


def safe_file_id(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]", "_")


def lacks_evidence(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    out = F.lit(False)
    for marker in MARKERS:
        out = out | F.contains(low, F.lit(marker))
    return out


def chinese_number(x: Column) -> Column:
    """Digits of any script in ``DIGITS``, or Chinese numerals below one hundred; null for others."""
    x = F.translate(x, DIGITS, "0123456789" * 4)
    digits = F.create_map(*(F.lit(v) for kv in {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}.items() for v in kv))
    tens, ones = F.substring_index(x, "十", 1), F.regexp_replace(x, "^[^十]*十", "")
    digit = lambda c, default: F.coalesce(F.try_element_at(digits, c), F.lit(default))
    return F.when(x.rlike(r"^\d+$"), x.try_cast("int")).when(x == "十", 10).when(F.contains(x, F.lit("十")), digit(tens, 1) * 10 + digit(ones, 0)).otherwise(F.try_element_at(digits, x))


def stable_id(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, 24))


def document_id(chunk_id: Column, content: Column) -> Column:
    return first_filled(strip(chunk_id), F.concat(F.lit("content-"), F.substring(F.sha2(content, 256), 1, 24)))


def readme_candidates(url: Column) -> Column:
    """Raw addresses to try for the page of a code host's repository or file; no others have any."""
    host, parts = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    raw = F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"))
    blob = (F.size(parts) >= 4) & (F.get(parts, F.lit(2)) == "blob")
    file = F.concat(raw, F.get(parts, F.lit(3)), F.lit("/"), F.array_join(F.slice(parts, F.lit(5), F.greatest(F.size(parts), F.lit(1))), "/"))
    both = F.array(F.concat(raw, F.lit("main/README.md")), F.concat(raw, F.lit("master/README.md")), url)
    none = F.array().cast("array<string>")
    return F.when(~F.coalesce(host.isin("github.com", "www.github.com"), F.lit(False)) | (F.size(parts) < 2), none).when(blob, F.array(file)).otherwise(both)
