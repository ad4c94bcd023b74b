"""Scalar text and date operators (X1-X9, X12-X16) as Column expressions.

All built-in functions, so they stay in whole-stage codegen. Regexes use
``(?U)`` where Python's Unicode classes are meant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C
from .regex import ustrip


def cut_with_ellipsis(t: Column, n: int) -> Column:
    """First n characters + '...' when longer than n."""
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(C.ELLIPSIS))).otherwise(t)


def message_text(t: Column, max_chars: int | None = C.MESSAGE_TEXT_LIMIT) -> Column:
    """Null or empty text -> the media placeholder, then the cut.

    ``max_chars=None`` keeps the whole text (what the scan uses)."""
    t = F.when(t.isNull() | (t == ""), F.lit(C.EMPTY_MESSAGE_TEXT)).otherwise(t)
    return t if max_chars is None else cut_with_ellipsis(t, max_chars)


def truncate_text(t: Column, n: int = C.MESSAGE_TEXT_LIMIT) -> Column:
    """X1."""
    return cut_with_ellipsis(t, n)


def compose_full_text(text: Column, ocr: Column) -> Column:
    """OCR empty -> text; text empty -> OCR; else text [OCR] ocr."""
    t = F.coalesce(text, F.lit(""))
    o = F.coalesce(ocr, F.lit(""))
    return (F.when(o == "", t)
            .when(t == "", o)
            .otherwise(F.concat(t, F.lit(C.OCR_SEPARATOR), o)))


# characters kept by X3; every other character becomes '?'
_CLEAN_DISALLOWED = r"""(?U)[^а-яА-ЯёЁa-zA-Z0-9\s.,!?()\[\]{}+*/=\\|"':;@#$%^&*+-]"""


def safe_clean_text(t: Column) -> Column:
    """X3: '?' for disallowed characters, collapse whitespace, strip; the
    sentinel when longer than 1000 or blank; '' for null/empty input."""
    x = F.regexp_replace(t, F.lit(_CLEAN_DISALLOWED), F.lit("?"))
    x = ustrip(F.regexp_replace(x, F.lit(r"(?U)\s+"), F.lit(" ")))
    return (F.when(t.isNull() | (t == ""), F.lit(""))
            .when((F.length(x) > C.OCR_CLEAN_LIMIT) | (x == ""), F.lit(C.OCR_CLEAN_SENTINEL))
            .otherwise(x))


def text_preview(t: Column) -> Column:
    """First 150 characters + '...'."""
    return cut_with_ellipsis(t, C.PREVIEW_LIMIT)


def parse_message_date(d: Column, batch_ts: Column) -> Column:
    """Drop from the first '.', from the first '+', drop 'Z', 'T' -> ' ',
    an offset after the time is dropped (not applied), read as UTC.
    Unparseable or null -> ``batch_ts`` (a job parameter, so reruns agree)."""
    s = F.substring_index(d, ".", 1)
    s = F.substring_index(s, "+", 1)
    s = F.regexp_replace(F.regexp_replace(s, "Z", ""), "T", " ")
    core = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}(?::\d{2})?)?)(?:-\d{2}(?::?\d{2})?)?$", 1)
    ts = F.coalesce(F.try_to_timestamp(core, F.lit("yyyy-MM-dd HH:mm:ss")),
                    F.try_to_timestamp(core, F.lit("yyyy-MM-dd HH:mm")),
                    F.try_to_timestamp(core, F.lit("yyyy-MM-dd")))
    return F.coalesce(ts, batch_ts)


# printable-or-space filter of X7: drop control/format/private/surrogate
# characters that are not whitespace (Python str.isprintable / isspace)
_NON_PRINTABLE = r"(?U)[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}&&[^\s\x1c-\x1f]]"


def ocr_normalize_text(t: Column) -> Column:
    """Keep printable or whitespace characters, collapse whitespace, strip."""
    x = F.regexp_replace(t, F.lit(_NON_PRINTABLE), F.lit(""))
    return ustrip(F.regexp_replace(x, F.lit(r"(?U)[\s\x1c-\x1f]+"), F.lit(" ")))


def correct_ocr_text(t: Column) -> Column:
    """Digit look-alikes -> letters, collapse whitespace, drop characters
    outside word/space/Cyrillic/'-'/'.'/',', strip. Empty stays empty."""
    x = F.translate(t, C.OCR_DIGIT_FROM, C.OCR_DIGIT_TO)
    x = F.regexp_replace(x, F.lit(r"(?U)\s+"), F.lit(" "))
    x = F.regexp_replace(x, F.lit(r"(?U)[^\w\sЀ-ӿ\-.,]"), F.lit(""))
    return F.when(t.isNull() | (t == ""), t).otherwise(ustrip(x))


def ocr_candidate_quality(t: Column) -> Column:
    """Alnum share x min(1, len/100), +0.1 with any U+0400..U+04FF; DOUBLE
    (compared as binary floats, like the reference)."""
    n = F.length(t).cast("double")
    alnum = F.length(F.regexp_replace(t, F.lit(r"(?U)[^\p{L}\p{N}]"), F.lit(""))).cast("double")
    q = (alnum / n) * F.least(F.lit(1.0), n / F.lit(100.0))
    bonus = F.when(t.rlike("[Ѐ-ӿ]"), F.lit(C.OCR_CYRILLIC_BONUS)).otherwise(F.lit(0.0))
    return F.when(n > 0, q + bonus)


def text_length(t: Column) -> Column:
    """Code-point length."""
    return F.length(t)


def word_count(t: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.size(F.regexp_extract_all(t, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


LEAK_JSON_SCHEMA = ("array<struct<type:string,value:string,confidence:double,"
                    "severity:double,position:int,priority:int>>")
SENDER_SCHEMA = "struct<id:bigint,username:string,first_name:string,last_name:string>"


def leaks_to_json(findings: Column) -> Column:
    """Findings array -> JSON text (fields in reference order)."""
    arr = F.transform(findings, lambda f: F.struct(
        f["type"].alias("type"), f["value"].alias("value"),
        f["confidence"].cast("double").alias("confidence"), f["severity"].cast("double").alias("severity"),
        f["pos"].alias("position"), f["priority"].alias("priority")))
    return F.coalesce(F.to_json(arr), F.lit("[]"))


def leaks_from_json(j: Column) -> Column:
    """JSON text -> findings array; empty/null -> empty array."""
    return F.coalesce(F.from_json(F.when(j != "", j), LEAK_JSON_SCHEMA), F.array().cast(LEAK_JSON_SCHEMA))


def sender_to_json(s: Column) -> Column:
    """Sender struct -> JSON text with null fields kept; missing -> '{}'."""
    return F.coalesce(F.to_json(s, {"ignoreNullFields": "false"}), F.lit("{}"))


def sender_from_json(j: Column) -> Column:
    """JSON text -> sender struct (null for '{}' or empty)."""
    return F.from_json(F.when((j != "") & (j != "{}"), j), SENDER_SCHEMA)


def truncate_words(t: Column, n: int = 100, leeway: int = 5) -> Column:
    """Template ``truncate(n)``: longer than n+leeway -> cut at n-3 back to
    the last space, then '...'; without a space the cut is kept."""
    cut = F.substring(t, 1, n - len(C.ELLIPSIS))
    head = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    return F.when(F.length(t) > n + leeway,
                  F.concat(F.when(F.instr(cut, " ") > 0, head).otherwise(cut), F.lit(C.ELLIPSIS))).otherwise(t)
