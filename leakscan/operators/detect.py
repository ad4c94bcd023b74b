"""Detector scan (D1-D27) and the per-finding projection.

Everything here is a narrow projection: one message row in, one row out
with an ``array<struct>`` of findings. No shuffle, no Python worker.
Cheap necessary conditions (a Cyrillic letter, a digit, a literal such
as ``@``) gate the regex work per row; they never change a result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.config_spans import config_spans_sql
from ..functions.regex import spans_sql, sql_str, ustrip_sql

CONF_TYPE = "decimal(4,2)"
WEIGHT_TYPE = "decimal(4,2)"

# one finding; the first four fields are the sort key of the dedup fold
FINDING_TYPE = ("array<struct<nrank:int,nconf:decimal(4,2),det:int,pos:int,type:string,value:string,full:string,"
                "confidence:decimal(4,2),severity:decimal(4,2),priority:int,rank:int,grp:string,weight:decimal(4,2)>>")

# Necessary-condition gates (our own optimisation, exact by construction).
# A Cyrillic letter (or a letter that case-folds to one) is required by every
# detector whose pattern cannot match without one.
_NEEDS_CYRILLIC = {
    "passport_series_number_request", "passport_rf", "passport_mention", "fio", "address",
    "pdn_auth_combo", "fio_phone_combo", "fio_address_combo", "passport_fio_combo",
}
_NEEDS_DIGIT = {
    "passport_series_number", "passport_rf", "passport_number", "inn", "snils", "birth_date",
    "fio_phone_combo", "phone_ru", "ipv4_private", "card_number",
}
# every alternative of these holds six digits in a row
_NEEDS_SIX_DIGITS = {"passport_series_number", "passport_rf", "passport_number", "inn"}
# Further necessary conditions, as clauses that must all hold; a clause
# holds when one of its words occurs. ("f", w): w occurs in the case-folded
# text ``_fold``; ("r", w): w occurs in the raw text. Every keyword-led
# pattern needs one of its keywords; ``_fold`` maps every character that
# Java's (?iU) equates with a keyword letter onto that letter, so the test
# is exact (the characters were enumerated from Java over the whole BMP).
def _f(*ws):
    return [("f", w) for w in ws]


def _r(*ws):
    return [("r", w) for w in ws]


_GATES = {
    "passport_series_number_request": [_f("пришли", "покажи", "отправь", "сфоткай", "фото", "скинь", "сери", "номер")],
    "passport_rf": [_f("паспорт")],
    "passport_mention": [_f("паспорт", "серия", "номер")],
    "snils": [_r("-")],
    "address": [_f("ул.", "улица", "пр.", "проспект", "пер.", "переулок", "дом", "д.", "кв.", "квартира",
                   "прописка", "адрес", "г.", "город")],
    "login_password_pair": [_f("логин", "login", "user"), _f("пароль", "pass", "pwd", "secret", "ключ", "токен"),
                            _r(":", "=")],
    "password": [_f("пароль", "pass", "pwd", "secret", "key", "credential", "токен", "auth", "ключ", "секрет"),
                 _r(":", "=")],
    "password_loose": [_f("пароль", "pass", "pwd", "secret", "key")],
    "pdn_auth_combo": [_f("паспорт", "инн", "снилс"), _f("логин", "пароль", "login", "password")],
    "fio_address_combo": [_f("ул.", "улица", "дом", "кв.", "квартира", "прописка", "адрес")],
    "passport_fio_combo": [_f("паспорт", "серия", "номер")],
    "email": [_r("@")],
    "free_email_combo": [_r("@"), _f("mail.ru", "yandex.ru", "bk.ru", "gmail.com", "inbox.ru", "list.ru", "rambler.ru",
                                    "ya.ru", "proton.me", "tutanota.com", "hotmail.com", "outlook.com")],
    "ipv4_private": [_r("10.", "172.", "192.168.")],
    "jwt_token": [_r("eyJ")],
    "api_key": [_f("key", "token"), _r(":", "=")],
    "private_key": [_r("-----BEGIN ")],
    "seed_phrase": [_f("seed", "мнемоника", "фразы", "wallet", "кошелёк")],
    # {...} needs '{' and '}'; the YAML form needs '- '
    "config_fragment": [_r("{", "- "), _r("}", "- ")],
}

# each word is looked up once per message, however many detectors ask for it
_WORDS = sorted({word for clauses in _GATES.values() for clause in clauses for word in clause})

# An address begins where its run of address characters begins, or where the last match
# ended: from any later place of the run the same "@" and domain decide, so other starts are
# skipped (a long run without a match is read once, not once per character).
_RUN_START = r"(?:(?<![a-zA-Z0-9_.+-])|\G)"
_FROM_RUN_START = {"email", "free_email_combo"}


# Likewise three names in a row begin where their first run of letters begins: from any later letter of the
# run the same spaces, names and words follow.
_LETTERS_START = r"(?:(?<!(?iU:[а-яё]))|\G)"
_FROM_LETTERS_START = {"fio_phone_combo", "fio_address_combo", "passport_fio_combo"}
# first letters of patterns that begin with a list of words: elsewhere the list isn't tried
_FIRST_LETTERS = {
    "passport_series_number_request": "посфн", "passport_rf": "п", "passport_mention": "псн", "address": "упдкаг",
    "login_password_pair": "лlu", "password": "пpskcтaкс", "password_loose": "пpsk", "pdn_auth_combo": "пис",
    "api_key": "as", "seed_phrase": "sмфwк",
}
# first characters of patterns that begin with a word boundary or a digit: a class is cheaper to refuse
_FIRST_CLASS = {
    "passport_series_number": r"[\dсн]", "passport_number": r"\d", "inn": r"\d", "snils": r"\d", "card_number": r"\d",
    "birth_date": "[0-3]", "phone_ru": "[+78]", "ipv4_private": "1",
}


def _begins_with(letters: str) -> str:
    """A look-ahead for one of these lower-case letters or what (?iU) equates with it."""
    same = {FOLD_PRE[1]: FOLD_PRE[0], "k": "\u212a"}
    every = [c for x in letters for c in (x, x.upper(), same.get(x, ""), *(f for f, t in zip(FOLD_FROM, FOLD_TO) if t == x))]
    return f"(?=[{''.join(every)}])"


def scan_pattern(d: C.Detector) -> str:
    start = (_RUN_START if d.name in _FROM_RUN_START else _LETTERS_START if d.name in _FROM_LETTERS_START
             else _begins_with(_FIRST_LETTERS[d.name]) if d.name in _FIRST_LETTERS
             else f"(?=(?U:{_FIRST_CLASS[d.name]}))" if d.name in _FIRST_CLASS else "")
    return start + d.java_pattern


def found_sql(d: C.Detector, text: str) -> str:
    """All matches of a detector with their positions: by its pattern, or, for the one pattern whose
    repetitions make an engine quadratic, by folds over the places that decide."""
    return config_spans_sql(text) if d.name == "config_fragment" else spans_sql(text, scan_pattern(d))


# characters that (?iU) equates with a keyword letter but lower() does not map to it
FOLD_PRE = ("İ", "i")
FOLD_FROM = "ıſᲀᲁᲂᲃᲄᲅᲆ"
FOLD_TO = "isвдосттъ"


def fold_sql(text: str) -> str:
    return (f"translate(lower(translate({text}, {sql_str(FOLD_PRE[0])}, {sql_str(FOLD_PRE[1])})), "
            f"{sql_str(FOLD_FROM)}, {sql_str(FOLD_TO)})")


# UTF-8 bytes without which no character of a kind occurs; the first four begin two-byte characters. Looking
# for bytes takes no decoding, and a byte found too much costs time only.
_CYR_BYTES = ("D0", "D1", "D2", "D3", "E1B2")
# a text without these is folded by lower() alone
_FOLDS_APART_BYTES = ("C4B0", "C4B1", "C5BF", "E1B2")


def is_blank(t: Column) -> Column:
    """Null or only (Unicode) whitespace; stops at the first other character."""
    return t.isNull() | ~t.rlike(r"(?U)[^\s\x1c-\x1f]")


def empty_findings() -> Column:
    return F.array().cast(FINDING_TYPE)


def _right(v: Column, k: int) -> Column:
    return F.substring(v, -k, k)


def mask(v: Column) -> Column:
    """Longer than 12 keeps 6+6 characters, longer than 8 keeps 4+4."""
    n = F.length(v)
    (long_n, long_k), (mid_n, mid_k) = C.MASK_LONG, C.MASK_MEDIUM
    return (F.when(n > long_n, F.concat(F.substring(v, 1, long_k), F.lit(C.ELLIPSIS), _right(v, long_k)))
            .when(n > mid_n, F.concat(F.substring(v, 1, mid_k), F.lit(C.ELLIPSIS), _right(v, mid_k)))
            .otherwise(v))


def _has_bytes(text: str, found: tuple) -> str:
    """SQL: the text holds one of these byte strings (hexadecimal); null: false."""
    return "coalesce(" + " OR ".join(f"contains(CAST({text} AS BINARY), X'{b}')" for b in found) + ", false)"


def _word_col(kind: str, word: str) -> str:
    return f"_{kind}{_WORDS.index((kind, word))}"


def _has_word(kind: str, word: str, text: str) -> str:
    """SQL of one gate word: a text without a Cyrillic letter isn't searched for Cyrillic words, whose
    letters share their first bytes, so that a search stops at every other one."""
    found = f"contains({'_fold' if kind == 'f' else text}, {sql_str(word)})"
    return f"(_cyr AND {found})" if re.search("[а-яё]", word) else found


def _cheap_conds(d: C.Detector) -> list:
    """What is known of a text before its folded form is searched, and the detector needs."""
    conds = []
    if d.name in _NEEDS_CYRILLIC:
        conds.append("_cyr")
    if d.name in _NEEDS_DIGIT:
        conds.append("_dig")
    if d.name in _NEEDS_SIX_DIGITS:
        conds.append("_dig6")
    return conds + [_clause_sql(clause) for clause in _GATES.get(d.name, []) if _is_raw(clause)]


def _is_raw(clause: list) -> bool:
    return all(kind == "r" for kind, _ in clause)


def _clause_sql(clause: list) -> str:
    return "(" + " OR ".join(_word_col(*word) for word in clause) + ")"


def _sql_gate(d: C.Detector) -> str | None:
    conds = _cheap_conds(d) + [_clause_sql(clause) for clause in _GATES.get(d.name, []) if not _is_raw(clause)]
    return " AND ".join(conds) if conds else None


def _asked_for(word: tuple, detectors) -> str | None:
    """SQL: some detector that looks for this word has all else that it needs; None: always."""
    needs = [" AND ".join(_cheap_conds(d)) for d in detectors
             if any(word in clause for clause in _GATES.get(d.name, []) if not _is_raw(clause))]
    return None if "" in needs else " OR ".join(f"({n})" for n in dict.fromkeys(needs))


def _sql_mask(v: str) -> str:
    (ln, lk), (mn, mk) = C.MASK_LONG, C.MASK_MEDIUM
    return (f"CASE WHEN length({v}) > {ln} THEN concat(substring({v}, 1, {lk}), {sql_str(C.ELLIPSIS)}, substring({v}, -{lk}, {lk})) "
            f"WHEN length({v}) > {mn} THEN concat(substring({v}, 1, {mk}), {sql_str(C.ELLIPSIS)}, substring({v}, -{mk}, {mk})) "
            f"ELSE {v} END")


def _with_helpers(df: DataFrame, text_col: str, detectors) -> DataFrame:
    """Helper columns of the detectors, each made once per message. Character by character folding
    (``translate``) is left to the few texts that need it."""
    t, tsql = F.col(text_col), f"`{text_col}`"
    dig = F.coalesce(t.rlike(r"(?U)\d"), F.lit(False))
    clauses = [clause for d in detectors for clause in _GATES.get(d.name, [])]
    raw = sorted({word for clause in clauses if _is_raw(clause) for word in clause})
    low = df.select("*", F.lower(t).alias("_lt"), F.length(t).alias("_len"),
                    F.expr(_has_bytes(tsql, _CYR_BYTES)).alias("_cyr"),
                    dig.alias("_dig"), is_blank(t).alias("_blank"),
                    *[F.expr(_has_word(*word, tsql)).alias(_word_col(*word)) for word in raw])
    six = F.when(F.col("_dig"), t.rlike(r"(?U)\d{6}")).otherwise(F.lit(False))
    apart = F.expr(_has_bytes(tsql, _FOLDS_APART_BYTES))
    folded = low.select("*", F.when(apart, F.expr(fold_sql(tsql))).otherwise(F.col("_lt")).alias("_fold"), six.alias("_dig6"))
    words = []
    for word in sorted({word for clause in clauses if not _is_raw(clause) for word in clause}):
        asked = _asked_for(word, detectors)
        found = _has_word(*word, tsql)
        words.append(F.expr(f"({asked}) AND {found}" if asked else found).alias(_word_col(*word)))
    return folded.select("*", *words)


def detector_sql(d: C.Detector, text: str = "`text`") -> str:
    """SQL of all findings of one detector in one message (F2-F6 applied).

    Uses the helper columns ``_lt`` (lower text), ``_len``, ``_cyr``,
    ``_dig``, ``_dig6``, ``_blank`` and the gate words of ``_with_helpers``. Stages: match
    spans -> stripped candidates passing F2/F3 -> context window (once per
    finding) -> confidence -> finding struct.
    """
    wl = ", ".join(sql_str(w) for w in C.WHITELIST)
    len_ok = "TRUE" if d.name in C.SHORT_VALUE_TYPES else f"length(c.v) >= {C.MIN_VALUE_LENGTH}"
    cand = (f"filter(transform({found_sql(d, text)}, "
            f"s -> named_struct('pos', s.pos, 'raw', s.raw, 'v', {ustrip_sql('s.raw')})), "
            f"c -> {len_ok} AND NOT lower(c.v) IN ({wl}))")
    start = f"greatest(0, c.pos - {C.CONTEXT_RADIUS})"
    end = f"least(_len, c.pos + length(c.raw) + {C.CONTEXT_RADIUS})"
    with_ctx = (f"transform({cand}, c -> named_struct('c', c, "
                f"'ctx', substring(_lt, {start} + 1, greatest({end} - {start}, 0))))")
    boost = " + ".join(f"CASE WHEN contains(w.ctx, {sql_str(x)}) THEN 1 ELSE 0 END" for x in d.boost) or "0"
    conf = (f"CAST(least(CAST(1.00 AS {CONF_TYPE}), CAST({d.severity} AS {CONF_TYPE}) + "
            f"CAST(({boost}) AS DECIMAL(4,0)) * {C.BOOST_STEP}BD) AS {CONF_TYPE})")
    with_conf = f"transform({with_ctx}, w -> named_struct('c', w.c, 'conf', {conf}))"
    build = (f"transform({with_conf}, w -> named_struct("
             f"'nrank', {-d.rank}, 'nconf', CAST(-w.conf AS {CONF_TYPE}), 'det', {d.no}, 'pos', w.c.pos, "
             f"'type', {sql_str(d.name)}, 'value', {_sql_mask('w.c.v')}, 'full', w.c.v, "
             f"'confidence', w.conf, 'severity', CAST({d.severity} AS {CONF_TYPE}), 'priority', {d.priority}, "
             f"'rank', {d.rank}, 'grp', {sql_str(d.group)}, 'weight', CAST({d.weight} AS {WEIGHT_TYPE})))")
    found = f"CAST({build} AS {FINDING_TYPE})"
    empty = f"CAST(array() AS {FINDING_TYPE})"
    gate = _sql_gate(d)
    if gate:
        return f"CASE WHEN _blank OR NOT ({gate}) THEN {empty} ELSE {found} END"
    return f"CASE WHEN _blank THEN {empty} ELSE {found} END"


def with_raw_findings(df: DataFrame, text_col: str = "text", out_col: str = "raw_findings",
                      detectors=None) -> DataFrame:
    """add the union of all detector findings of each row (unsorted).

    Blank text gives no findings. Three projections: helper columns, one
    array per detector, their concatenation.
    """
    detectors = C.DETECTORS if detectors is None else detectors
    base = df.columns
    helpers = _with_helpers(df, text_col, detectors)
    tsql = f"`{text_col}`"
    arrays = helpers.select(*base, *[F.expr(detector_sql(d, tsql)).alias(f"_d{d.no}") for d in detectors])
    cols = [F.col(f"_d{d.no}") for d in detectors]
    return arrays.select(*base, (F.concat(*cols) if cols else empty_findings()).alias(out_col))


STEP_TYPE = ("array<struct<type:string,det:int,pos:int,raw:string,v:string,len_ok:boolean,wl_ok:boolean,"
             "ctx:string,boost:int,confidence:decimal(4,2),value:string,severity:decimal(4,2),priority:int>>")


def detector_steps_sql(d: C.Detector, text: str = "`text`") -> str:
    """Every match of one detector with the outcome of each step F2-F6
    (length floor, whitelist, context window, boost count, confidence,
    masked value), before the filters drop anything."""
    wl = ", ".join(sql_str(w) for w in C.WHITELIST)
    len_ok = "TRUE" if d.name in C.SHORT_VALUE_TYPES else f"length(c.v) >= {C.MIN_VALUE_LENGTH}"
    cand = (f"transform({found_sql(d, text)}, "
            f"s -> named_struct('pos', s.pos, 'raw', s.raw, 'v', {ustrip_sql('s.raw')}))")
    start = f"greatest(0, c.pos - {C.CONTEXT_RADIUS})"
    end = f"least(_len, c.pos + length(c.raw) + {C.CONTEXT_RADIUS})"
    with_ctx = (f"transform({cand}, c -> named_struct('c', c, 'len_ok', {len_ok}, "
                f"'wl_ok', NOT lower(c.v) IN ({wl}), "
                f"'ctx', substring(_lt, {start} + 1, greatest({end} - {start}, 0))))")
    boost = " + ".join(f"CASE WHEN contains(w.ctx, {sql_str(x)}) THEN 1 ELSE 0 END" for x in d.boost) or "0"
    build = (f"transform({with_ctx}, w -> named_struct("
             f"'type', {sql_str(d.name)}, 'det', {d.no}, 'pos', w.c.pos, 'raw', w.c.raw, 'v', w.c.v, "
             f"'len_ok', w.len_ok, 'wl_ok', w.wl_ok, 'ctx', w.ctx, 'boost', {boost}, "
             f"'confidence', CAST(least(CAST(1.00 AS {CONF_TYPE}), CAST({d.severity} AS {CONF_TYPE}) + "
             f"CAST(({boost}) AS DECIMAL(4,0)) * {C.BOOST_STEP}BD) AS {CONF_TYPE}), "
             f"'value', {_sql_mask('w.c.v')}, 'severity', CAST({d.severity} AS {CONF_TYPE}), 'priority', {d.priority}))")
    found = f"CAST({build} AS {STEP_TYPE})"
    empty = f"CAST(array() AS {STEP_TYPE})"
    gate = _sql_gate(d)
    if gate:
        return f"CASE WHEN _blank OR NOT ({gate}) THEN {empty} ELSE {found} END"
    return f"CASE WHEN _blank THEN {empty} ELSE {found} END"


def with_finding_steps(df: DataFrame, text_col: str = "text", out_col: str = "steps", detectors=None) -> DataFrame:
    detectors = C.DETECTORS if detectors is None else detectors
    base = df.columns
    helpers = _with_helpers(df, text_col, detectors)
    tsql = f"`{text_col}`"
    arrays = helpers.select(*base, *[F.expr(detector_steps_sql(d, tsql)).alias(f"_s{d.no}") for d in detectors])
    return arrays.select(*base, F.concat(*[F.col(f"_s{d.no}") for d in detectors]).alias(out_col))


def explode_fields(df: DataFrame, keys, arr_col: str, fields: dict, pos_name: str | None = None) -> DataFrame:
    """One row per array element with only ``fields`` (name -> expression
    over the element ``e``).

    The fields are projected inside the array before the explode, so the
    optimizer has no nested field access to push below the generator (it
    would otherwise copy the expensive array expression once per field).
    """
    arr = F.transform(F.col(arr_col), lambda e: F.struct(*[fn(e).alias(n) for n, fn in fields.items()]))
    if pos_name:
        return df.select(*keys, F.posexplode(arr).alias(pos_name, "_e")).select(*keys, pos_name, "_e.*")
    return df.select(*keys, F.explode(arr).alias("_e")).select(*keys, "_e.*")
