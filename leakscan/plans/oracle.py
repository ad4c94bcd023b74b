"""Independent DuckDB SQL oracles (the correctness gate).

Written from the rules, not from the Spark code. Detector patterns are
restated for RE2, whose ``\\b \\w \\d \\s`` are ASCII-only:

* ``\\d`` -> ``\\p{Nd}``, ``\\s`` -> the Python whitespace set, ``\\w`` ->
  ``[\\pL\\pN_]``;
* patterns with ``\\b`` run on a *marked* text in which every maximal
  run of word characters is wrapped in U+0001 (so each marker sits exactly
  on a word boundary); ``\\b`` becomes the marker, every place where a
  run can end inside the pattern accepts ``marker gap marker``. Positions
  and values are mapped back by dropping the markers.

Positions come from ``regexp_extract_all`` + ``string_split_regex`` (start
of match i = lengths of the gaps and matches before it), a different
route from the Spark side.
"""

from __future__ import annotations

from .. import catalog as C
from .fixtures import BASE_TS, TEMPLATE_CYCLE, TEMPLATES

# --- RE2 building blocks ----------------------------------------------------
WSI = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\pZ"   # Python str.isspace() set (inner)
WS = "[" + WSI + "]"
WI = r"\pL\pN_"                           # Python \w (inner)
DG = r"\p{Nd}"
MK = r"\x01"
GAP = "(?:{M}{WS}+{M})?"                 # optional whitespace gap between two word runs


def _re(p: str) -> str:
    return (p.replace("{GAP}", GAP).replace("{WSI}", WSI).replace("{WS}", WS)
             .replace("{WI}", WI).replace("{D}", DG).replace("{M}", MK))


# name -> (RE2 pattern, runs on marked text)
RE2 = {
    "passport_series_number_request": (_re(
        r"(?i)(пришли|покажи|отправь|сфоткай|фото|скинь|серию и номер|серия и номер паспорта|серия номер паспорта|серия паспорта|номер паспорта|серия|номер){WS}*(и|паспорта)?"), False),
    "passport_series_number": (_re(
        r"{M}(?:{D}{4}(?:{M}{WS}{0,2}[№#]?{WS}{0,2}{M})?{D}{6}"
        r"|серия{GAP}{D}{4}(?:{GAP}(?:и|номер){GAP}|{GAP}){D}{6}"
        r"|номер{GAP}{D}{6}(?:{GAP}(?:и|серия){GAP}|{GAP}){D}{4}){M}"), True),
    "passport_rf": (_re(
        r"""(?i)(паспорт|паспортные данные|паспорт рф|паспорт гражданина рф){WS}*[:=]?{WS}*["']?({D}{4}{WS}?{D}{6})["']?"""), False),
    "passport_number": (_re(r"{M}{D}{4}(?:{M}{WS}{M})?{D}{6}{M}"), True),
    "passport_mention": (_re(
        r"(?i){M}(?:паспорт|паспортные{M} {M}данные|паспорт{M} {M}рф|серия{M} {M}паспорта|номер{M} {M}паспорта|серия|номер){M}"), True),
    "inn": (_re(r"{M}(?:{D}{10}|{D}{12}){M}"), True),
    "snils": (_re(r"{M}{D}{3}{M}-{M}{D}{3}{M}-{M}{D}{3}(?:{M}{WS}{M})?{D}{2}{M}"), True),
    "fio": (_re(r"(?i){M}[А-ЯЁ][а-яё]{2,}{M}{WS}+{M}[А-ЯЁ][а-яё]{2,}{M}{WS}+{M}[А-ЯЁ][а-яё]{2,}{M}"), True),
    "address": (_re(
        r"(?i)(ул\.|улица|пр\.|проспект|пер\.|переулок|дом|д\.|кв\.|квартира|прописка|адрес|г\.|город){WS}*[{WI}{WSI}\p{Nd}.,-]+"), False),
    "birth_date": (_re(r"{M}(0[1-9]|[12][0-9]|3[01])(?:{M}[./-]{M})?(0[1-9]|1[0-2])(?:{M}[./-]{M})?({D}{2,4}){M}"), True),
    "login_password_pair": (_re(
        r"""(?i)(логин|login|username|user){WS}*[:=]{WS}*["']?([^"{WSI}@]+)["']?{WS}*[,;]?{WS}*(пароль|password|pass|pwd|secret|ключ|токен){WS}*[:=]{WS}*["']?([^"{WSI}]{4,})["']?"""), False),
    "password": (_re(
        r"""(?i)(пароль|password|pass|pwd|secret|key|credential|токен|auth|ключ|секрет){WS}*[:=]{WS}*["']?([^"{WSI}]{4,})["']?"""), False),
    "password_loose": (_re(r"(?i)(пароль|password|pass|pwd|secret|key){WS}+([^{WSI}]{4,})"), False),
    "pdn_auth_combo": (_re(r"(?i)(паспорт|инн|снилс).{0,80}?(логин|пароль|login|password)"), False),
    "fio_phone_combo": (_re(
        r"(?i)([А-ЯЁ][а-яё]+{WS}+[А-ЯЁ][а-яё]+{WS}+[А-ЯЁ][а-яё]+).{0,80}?(\+7|8|7){WS}?[\({WSI}-]?{D}{3}[\){WSI}-]?{D}{3}[{WSI}-]?{D}{2}[{WSI}-]?{D}{2}"), False),
    "fio_address_combo": (_re(
        r"(?i)([А-ЯЁ][а-яё]+{WS}+[А-ЯЁ][а-яё]+{WS}+[А-ЯЁ][а-яё]+).{0,80}?(ул\.|улица|дом|кв\.|квартира|прописка|адрес)"), False),
    "passport_fio_combo": (_re(
        r"(?i)([А-ЯЁ][а-яё]+{WS}+[А-ЯЁ][а-яё]+{WS}+[А-ЯЁ][а-яё]+).{0,80}?(паспорт|паспортные данные|серия|номер)"), False),
    "email": (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+", False),
    "free_email_combo": (
        r"(?i)[a-zA-Z0-9_.+-]+@(mail\.ru|yandex\.ru|bk\.ru|gmail\.com|inbox\.ru|list\.ru|rambler\.ru|ya\.ru|proton\.me|tutanota\.com|hotmail\.com|outlook\.com)", False),
    "phone_ru": (_re(r"(\+7|8|7){WS}?[\({WSI}-]?{D}{3}[\){WSI}-]?{D}{3}[{WSI}-]?{D}{2}[{WSI}-]?{D}{2}"), False),
    "ipv4_private": (_re(
        r"{M}(?:10{M}\.{M}{D}{1,3}{M}\.{M}{D}{1,3}{M}\.{M}{D}{1,3}"
        r"|172{M}\.{M}(?:1[6-9]|2[0-9]|3[0-1]){M}\.{M}{D}{1,3}{M}\.{M}{D}{1,3}"
        r"|192{M}\.{M}168{M}\.{M}{D}{1,3}{M}\.{M}{D}{1,3}){M}"), True),
    "jwt_token": (r"eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.?[A-Za-z0-9_.+/=-]*", False),
    "api_key": (_re(
        r"""(?i)(api[-_]?key|access[-_]?key|secret[-_]?key|auth[-_]?token){WS}*[:=]{WS}*["']?([A-Za-z0-9+/=._-]{20,})["']?"""), False),
    "private_key": (
        r"-----BEGIN (RSA|OPENSSH|DSA|EC|PGP) PRIVATE KEY-----[\s\S]*?-----END (RSA|OPENSSH|DSA|EC|PGP) PRIVATE KEY-----", False),
    "card_number": (_re(r"{M}(?:{D}(?:{M}[ -]+{M})?){13,16}{M}"), True),
    "seed_phrase": (_re(
        r"""(?i)(seed|мнемоника|фразы|wallet|кошелёк){WS}*[:=]?{WS}*["']?([a-zA-Z]+(?:{WS}+[a-zA-Z]+){11,23})["']?"""), False),
    "config_fragment": (_re(
        r"""(\{.*(password|key|token|secret|pass|pwd|api_key).*:{WS}*["']?[^"']+["']?\})|(- [{WI}]+: [{WI}]+)"""), False),
}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _in_list(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


# --- fixtures -----------------------------------------------------------------
def msgs_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(TEMPLATES))
    ts = f"(TIMESTAMP '{BASE_TS}' + d.doc_id * INTERVAL 1 MINUTE)"
    base = f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"
    return f"""
    SELECT CAST(substr(d.source, 4, 12) AS BIGINT) AS chat_id,
           CAST(d.doc_id AS BIGINT) AS message_id,
           CASE d.doc_id % 4 WHEN 0 THEN {base} || '+00:00' WHEN 1 THEN {base} || '.123+03:00'
                             WHEN 2 THEN {base} || 'Z' END AS date,
           CAST(1000 + d.doc_id % 50 AS BIGINT) AS sender_id,
           CASE WHEN tm.t IS NULL THEN d.text ELSE tm.t || ' ' || coalesce(d.text, '') END AS text,
           d.doc_id % 6 = 0 AS is_forward, d.doc_id % 8 = 0 AS "out", d.doc_id % 7 = 0 AS media,
           CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE
             {{'id': CAST(1000 + d.doc_id % 50 AS BIGINT),
               'username': CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 'user' || CAST(1000 + d.doc_id % 50 AS VARCHAR) END,
               'first_name': 'Name' || CAST(d.doc_id % 10 AS VARCHAR),
               'last_name': CAST(NULL AS VARCHAR)}} END AS sender,
           CAST(coalesce(l.toxic, 0) * 0.9 AS DECIMAL(5,3)) AS model_score
    FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id
    CROSS JOIN LATERAL (SELECT CASE d.doc_id % {TEMPLATE_CYCLE} {cases} END AS t) tm
    """


BLANK = f"(text IS NULL OR regexp_full_match(text, '{WS}*'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _mask(v: str) -> str:
    return (f"CASE WHEN length({v}) > 12 THEN left({v}, 6) || '...' || right({v}, 6) "
            f"WHEN length({v}) > 8 THEN left({v}, 4) || '...' || right({v}, 4) ELSE {v} END")


def detector_select(d: C.Detector, src: str = "scan_src", steps: bool = False) -> str:
    """Findings of one detector over ``src(chat_id, message_id, text)``:
    chat_id, message_id, det, type, pos, raw, v (stripped), value (masked),
    confidence DECIMAL(4,2), rank, grp, weight."""
    pat, marked = RE2[d.name]
    pl = q(pat)
    hay = "regexp_replace(text, '([\\pL\\pN_]+)', chr(1) || '\\1' || chr(1), 'g')" if marked else "text"
    pos_expr = ("CAST(coalesce(list_sum(list_transform(gaps[1:i+1], lambda g: length(g))), 0)"
                " + coalesce(list_sum(list_transform(vals[1:i], lambda v: length(v))), 0) AS BIGINT)")
    if marked:
        span = (f"{{'pos': CAST(length(replace(left(h, {pos_expr}), chr(1), '')) AS BIGINT), "
                f"'raw': replace(vals[i+1], chr(1), '')}}")
    else:
        span = f"{{'pos': {pos_expr}, 'raw': vals[i+1]}}"
    boost = " + ".join(f"CAST(contains(ctx, {q(w)}) AS INTEGER)" for w in d.boost) or "0"
    len_ok = "TRUE" if d.name in C.SHORT_VALUE_TYPES else "length(v) >= 3"
    wl_ok = f"lower(v) NOT IN {_in_list(C.WHITELIST)}"
    where = "TRUE" if steps else f"{len_ok} AND {wl_ok}"
    return f"""
    SELECT chat_id, message_id, {d.no} AS det, {q(d.name)} AS type, pos, raw, v, {_mask('v')} AS value,
           CAST(least(1.00, {d.severity} + 0.15 * ({boost})) AS DECIMAL(4,2)) AS confidence,
           {d.rank} AS rank, {q(d.group)} AS grp, CAST({d.weight} AS DECIMAL(4,2)) AS weight,
           CAST({d.severity} AS DECIMAL(4,2)) AS severity, {d.priority} AS priority,
           {len_ok} AS len_ok, {wl_ok} AS wl_ok, ctx, CAST(({boost}) AS INTEGER) AS boost
    FROM (
      SELECT *, substr(lower(text), greatest(0, pos - 100) + 1,
                       least(length(text), pos + length(raw) + 100) - greatest(0, pos - 100)) AS ctx
      FROM (
        SELECT chat_id, message_id, text, s.pos AS pos, s.raw AS raw, {_strip('s.raw')} AS v
        FROM (
          SELECT chat_id, message_id, text,
                 unnest(list_transform(range(len(vals)), lambda i: {span})) AS s
          FROM (
            SELECT chat_id, message_id, text, h,
                   regexp_extract_all(h, {pl}, 0) AS vals, string_split_regex(h, {pl}) AS gaps
            FROM (SELECT chat_id, message_id, text, {hay} AS h FROM {src} WHERE NOT {BLANK.replace('text', 'text')}) x0
          ) x1
        ) x2
      ) x3
      WHERE {where}
    ) x4
    """


def raw_findings_sql(src: str = "scan_src") -> str:
    return "\nUNION ALL\n".join(detector_select(d, src) for d in C.DETECTORS)


_FOLD = """list_reduce(fl, lambda acc, f:
        CASE WHEN coalesce(list_bool_or(list_transform(acc, lambda k: k.type = f.type)), FALSE)
               OR coalesce(list_bool_or(list_transform(acc, lambda k: k.grp = f.grp AND
                    CASE WHEN k.pos = 0 OR f.pos = 0
                         THEN abs(CAST(k.confidence AS DOUBLE) - CAST(f.confidence AS DOUBLE)) < 0.3
                         ELSE abs(k.pos - f.pos) < 50 END)), FALSE)
             THEN acc ELSE list_append(acc, f) END, fl[1:0])"""


def analysis_ctes(src_sql: str, text_col_sql: str = "text") -> str:
    """CTEs ``scan_src``, ``rf`` (raw findings), ``kept`` (one row per kept
    finding with its output order ``ord``) and ``scored`` (one row per
    message with n_raw, n_kept, leaks text and sx_score)."""
    return f"""
    scan_src AS ({src_sql}),
    rf AS ({raw_findings_sql('scan_src')}),
    lists AS (
      SELECT chat_id, message_id, count(*) AS n_raw,
             list({{'pos': pos, 'det': det, 'type': type, 'value': value, 'confidence': confidence,
                   'rank': rank, 'grp': grp, 'weight': weight, 'severity': severity, 'priority': priority}}
                  ORDER BY rank DESC, confidence DESC, det, pos) AS fl
      FROM rf GROUP BY chat_id, message_id),
    folded AS (SELECT chat_id, message_id, n_raw, {_FOLD} AS kl FROM lists),
    kept AS (
      SELECT chat_id, message_id, n_raw, k.pos AS pos, k.type AS type, k.value AS value,
             k.confidence AS confidence, k.grp AS grp, k.weight AS weight, k.severity AS severity,
             k.priority AS priority, k.rank AS rank, k.det AS det, fold_ord,
             row_number() OVER (PARTITION BY chat_id, message_id ORDER BY k.pos, fold_ord) AS ord
      FROM (SELECT chat_id, message_id, n_raw, unnest(kl) AS k, unnest(range(len(kl))) AS fold_ord FROM folded) u),
    agg AS (
      SELECT chat_id, message_id, max(n_raw) AS n_raw, count(*) AS n_kept,
             max(confidence) AS max_conf,
             count(DISTINCT grp) AS n_cat,
             count(DISTINCT type) AS n_types,
             CAST(sum(confidence * weight) AS DECIMAL(12,6)) AS wsum,
             bool_or(type IN ('free_email_combo', 'email')) AS has_mail,
             bool_or(contains(type, 'passport')) AS has_pass,
             string_agg(CAST(pos AS VARCHAR) || ':' || type || ':' || CAST(confidence AS VARCHAR) || ':' || value, '; ' ORDER BY ord) AS leaks,
             to_json(list({{'type': type, 'value': value, 'confidence': CAST(confidence AS DOUBLE),
                           'severity': CAST(severity AS DOUBLE), 'position': CAST(pos AS INTEGER),
                           'priority': CAST(priority AS INTEGER)}} ORDER BY ord)) AS leaks_json
      FROM kept GROUP BY chat_id, message_id),
    scored AS (
      SELECT s.chat_id, s.message_id, s.text AS text,
             coalesce(a.n_raw, 0) AS n_raw, coalesce(a.n_kept, 0) AS n_kept, coalesce(a.leaks, '') AS leaks,
             coalesce(a.leaks_json, '[]') AS leaks_json, a.has_mail, a.has_pass,
             a.n_types, a.n_cat, a.max_conf, a.wsum, s.model_eff,
             CASE WHEN coalesce(a.n_kept, 0) = 0 AND s.model_eff < 0.5 THEN 0.0 ELSE CAST(round(CAST(
               least(1, greatest(0,
                 0.50 * CAST(least(1, greatest(0,
                     coalesce(a.max_conf, 0) * 0.50 + coalesce(a.wsum, 0) * 0.30
                     + CASE WHEN a.n_cat >= 3 THEN 0.40 WHEN a.n_cat >= 2 THEN 0.25 ELSE 0 END
                     + CASE WHEN a.has_mail AND a.n_cat >= 2 THEN 0.15 ELSE 0 END
                     + least(0.45, (coalesce(a.n_kept, 0) - 1) * 0.09))) AS DECIMAL(12,6))
                 + (CASE WHEN coalesce(a.n_kept, 0) = 0 THEN 0.20 WHEN a.has_pass THEN 0.40 ELSE 0.35 END)
                   * (CASE WHEN coalesce(length(s.text), 0) < 20 THEN 0.7 ELSE 1.0 END) * s.model_eff
                 + CASE WHEN a.has_pass AND s.model_eff > 0.8 THEN 0.22 ELSE 0 END
                 + coalesce(a.n_kept, 0) * 0.01)) AS DECIMAL(16,8)), 3) AS DOUBLE) END AS sx_score
      FROM (SELECT chat_id, message_id, text,
                   CASE WHEN {BLANK} THEN CAST(0 AS DECIMAL(5,3)) ELSE CAST(coalesce(model_score, 0) AS DECIMAL(5,3)) END AS model_eff
            FROM scan_src) s
      LEFT JOIN agg a ON a.chat_id = s.chat_id AND a.message_id = s.message_id)
    """


# --- scalar text operators (X1-X16) in DuckDB ---------------------------------
def cut_sql(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) > {n} THEN substr({t}, 1, {n}) || '...' ELSE {t} END"


def compose_sql(t: str, o: str) -> str:
    return (f"CASE WHEN coalesce({o}, '') = '' THEN coalesce({t}, '') WHEN coalesce({t}, '') = '' THEN {o} "
            f"ELSE {t} || ' [OCR] ' || {o} END")


def clean_sql(t: str) -> str:
    x = rf"""regexp_replace({t}, '[^а-яА-ЯёЁa-zA-Z0-9{WSI}.,!?()\[\]{{}}+*/=\\|"'':;@#$%^&*+-]', '?', 'g')"""
    x = _strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")
    return (f"CASE WHEN {t} IS NULL OR {t} = '' THEN '' WHEN length({x}) > 1000 OR {x} = '' "
            f"THEN '{C.OCR_CLEAN_SENTINEL}' ELSE {x} END")


def date_sql(d: str, fallback: str) -> str:
    s_ = f"replace(replace(split_part(split_part({d}, '.', 1), '+', 1), 'Z', ''), 'T', ' ')"
    core = (f"regexp_extract({s_}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?: [0-9]{{2}}:[0-9]{{2}}(?::[0-9]{{2}})?)?)"
            f"(?:-[0-9]{{2}}(?::?[0-9]{{2}})?)?$', 1)")
    return (f"coalesce(try_strptime({core}, '%Y-%m-%d %H:%M:%S'), try_strptime({core}, '%Y-%m-%d %H:%M'), "
            f"try_strptime({core}, '%Y-%m-%d'), {fallback})")


def normalize_sql(t: str) -> str:
    x = f"regexp_replace({t}, '[\\x00-\\x08\\x0e-\\x1b\\x7f-\\x84\\x86-\\x9f\\p{{Cf}}\\p{{Co}}]', '', 'g')"
    return _strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def correct_sql(t: str) -> str:
    x = f"translate({t}, '{C.OCR_DIGIT_FROM}', '{C.OCR_DIGIT_TO}')"
    x = f"regexp_replace({x}, '{WS}+', ' ', 'g')"
    x = f"regexp_replace({x}, '[^{WI}{WSI}\\x{{0400}}-\\x{{04FF}}.,-]', '', 'g')"
    return f"CASE WHEN {t} IS NULL OR {t} = '' THEN {t} ELSE {_strip(x)} END"


def quality_sql(t: str) -> str:
    n = f"CAST(length({t}) AS DOUBLE)"
    a = f"CAST(length(regexp_replace({t}, '[^\\pL\\pN]', '', 'g')) AS DOUBLE)"
    return (f"CASE WHEN length({t}) > 0 THEN ({a} / {n}) * least(1.0, {n} / 100.0) + "
            f"CASE WHEN regexp_matches({t}, '[\\x{{0400}}-\\x{{04FF}}]') THEN 0.1 ELSE 0.0 END END")


def preview_sql(t: str) -> str:
    return cut_sql(t, C.PREVIEW_LIMIT)


def truncate_words_sql(t: str, n: int = 100, leeway: int = 5) -> str:
    cut = f"substr({t}, 1, {n - 3})"
    head = f"regexp_extract({cut}, '(?s)^(.*) ', 1)"
    return (f"CASE WHEN length({t}) > {n + leeway} THEN "
            f"(CASE WHEN strpos({cut}, ' ') > 0 THEN {head} ELSE {cut} END) || '...' ELSE {t} END")


def mask_sql(v: str) -> str:
    return _mask(v)


def word_count_sql(t: str) -> str:
    return f"len(regexp_extract_all({t}, '[^{WSI}]+', 0))"


# --- composed flow: OCR, analysis, alerts ---------------------------------------
def ocr_ctes() -> str:
    """CTEs msgs, ocr_cand, ocr_best_img (image_id, ocr_text over all images), ocr (message_id, ocr_text)."""
    clean = correct_sql(normalize_sql(_strip("text")))
    return f"""
    msgs AS ({msgs_sql()}),
    att AS (SELECT CAST(conv_id AS BIGINT) AS message_id, encode(text) AS content FROM conversations WHERE turn = 0),
    media_att AS (SELECT m.chat_id, m.message_id FROM msgs m JOIN att a ON a.message_id = m.message_id
                  WHERE m.media AND octet_length(a.content) >= 100),
    ocr_cand AS (SELECT CAST(conv_id AS BIGINT) AS image_id, CAST(turn // 4 AS INTEGER) AS variant_no,
                        CAST(turn % 4 AS INTEGER) AS param_no, 640 AS width,
                        CASE WHEN conv_id % 9 = 0 THEN 40 ELSE 480 END AS height,
                        CASE WHEN conv_id % 13 = 0 THEN '   ' ELSE text END AS text
                 FROM conversations),
    ocr_clean AS (SELECT image_id, variant_no, param_no, {clean} AS clean FROM ocr_cand WHERE height >= 50 AND width >= 50),
    ocr_q AS (SELECT *, {quality_sql('clean')} AS quality FROM ocr_clean),
    ocr_top AS (SELECT image_id, clean FROM (
                  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY quality DESC, variant_no, param_no) AS rn
                  FROM ocr_q WHERE clean <> '' AND quality > 0) t WHERE rn = 1),
    ocr_base AS (SELECT CAST(conv_id AS BIGINT) AS image_id, {correct_sql(_strip('text'))} AS base_text
                 FROM conversations WHERE turn = 0 AND conv_id % 5 <> 0),
    images AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS image_id FROM conversations),
    ocr_best_img AS (SELECT i.image_id, coalesce(nullif(b.clean, ''), nullif(bs.base_text, ''), '{C.OCR_NOT_RECOGNISED}') AS ocr_text
                     FROM images i LEFT JOIN ocr_top b ON b.image_id = i.image_id LEFT JOIN ocr_base bs ON bs.image_id = i.image_id),
    ocr AS (SELECT ma.message_id, o.ocr_text FROM media_att ma JOIN ocr_best_img o ON o.image_id = ma.message_id)
    """


def analyzed_ctes() -> str:
    """CTEs up to ``an``: one row per message with scan, score, OCR and alert fields."""
    m2 = f"""
    m2 AS (SELECT m.*, CASE WHEN m.text IS NULL OR m.text = '' THEN '{C.EMPTY_MESSAGE_TEXT}' ELSE m.text END AS text2,
                  CASE WHEN m.media THEN coalesce(o.ocr_text, '') ELSE '' END AS ocr_raw
           FROM msgs m LEFT JOIN ocr o ON o.message_id = m.message_id),
    m3 AS (SELECT *, {compose_sql('text2', 'ocr_raw')} AS full_text, message_id % 11 = 0 AS is_processed FROM m2),"""
    return ocr_ctes() + "," + m2 + analysis_ctes(
        "SELECT chat_id, message_id, full_text AS text, model_score FROM m3") + f""",
    an AS (SELECT m3.chat_id, m3.message_id, m3.date, m3.sender_id, m3.text2 AS text, m3.is_forward, m3."out", m3.media,
                  m3.full_text, m3.sender, s.n_raw, s.n_kept, s.leaks, s.leaks_json,
                  CAST(s.model_eff AS DOUBLE) AS model_score, s.sx_score,
                  s.sx_score > 0.55 AND NOT m3.is_processed AS alert,
                  m3.ocr_raw <> '' AS has_ocr, {clean_sql('m3.ocr_raw')} AS ocr_text
           FROM m3 JOIN scored s ON s.chat_id = m3.chat_id AND s.message_id = m3.message_id)
    """


ALERT_DAY0_SQL = "TIMESTAMP '2024-01-20 00:00:00'"


def alerts_ctes() -> str:
    """... plus ``al``: the stored alert rows (A3), before the FLOAT cast."""
    created = f"({ALERT_DAY0_SQL} + CAST(floor(message_id / 50) AS INTEGER) * INTERVAL 1 DAY)"
    return analyzed_ctes() + f""",
    al AS (SELECT chat_id, message_id, sx_score, model_score, {preview_sql('full_text')} AS text_preview,
                  leaks_json AS leaks, ocr_text,
                  coalesce(to_json(sender), '{{}}') AS sender,
                  {date_sql('date', created)} AS date, {created} AS created_at
           FROM an WHERE alert),
    st AS (SELECT chat_id, message_id, CAST(CAST(sx_score AS FLOAT) AS DOUBLE) AS sx_score,
                  CAST(CAST(model_score AS FLOAT) AS DOUBLE) AS model_score, text_preview, leaks, ocr_text, sender,
                  date, created_at, strftime(created_at, '%Y%m') AS month FROM al)
    """
