"""DuckDB SQL of the queries that SQL can express, over whole tables: formatted conversations
(op7), quality rules (op10) and vector codes (op12). The SQL counts words, windows, lines,
distances and codebooks by joins and groups of its own."""

from __future__ import annotations

from .chat import CONTROL
from .code_compress import ENTRIES, PARTS, ROUNDS, SCALE
from .quality import QualityRules


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chat_sql() -> str:
    """Lengths of the escaped texts are counted: one backslash for each backslash and control string."""
    marks = len("<|turn|><|says|><|end|>\n")
    breaks = "".join(f" + (length({{0}}) - length(replace({{0}}, {_text(c)}, ''))) // {len(c)}" for c in CONTROL)
    escaped = "(length({0}) + length({0}) - length(replace({0}, chr(92), ''))" + breaks + ")"
    order = "ORDER BY turn NULLS FIRST, role, text"
    said = _text("</s>[INST] ok [/INST]")
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})) AS own(conv_id, turn, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS turns,
    coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({marks} + {escaped.format('role')} + {escaped.format('text')}) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g"""


def quality_sql(rules: QualityRules = QualityRules()) -> str:
    """Histograms in long form (row, kind, bin), references as sums, distances as sums over bins."""
    both = sorted({w for ws in rules.words.values() for w in ws[:5]})
    lists = {**rules.words, "other": both}
    width = max(map(len, lists.values()))
    listed = ", ".join(f"({_text(lang)}, {_text(w)}, {k})" for lang, ws in lists.items() for k, w in enumerate(ws))
    langs = ", ".join(map(_text, rules.words))

    def round_(n: int, good: str) -> str:
        return f"""
ref{n} AS (SELECT ref_lang, kind, k, sum(c) AS c FROM hist JOIN base USING (rid) WHERE {good} GROUP BY ALL),
share{n} AS (SELECT ref_lang, kind, k, c / nullif(sum(c) OVER (PARTITION BY ref_lang, kind), 0) AS q FROM ref{n}),
dist{n} AS (
  SELECT rid, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM part JOIN base USING (rid) JOIN share{n} USING (ref_lang, kind, k) GROUP BY rid, kind),
kept{n} AS (
  SELECT b.rid, NOT base_failed
    AND (n_chars < {rules.min_chars} OR coalesce(c.d, 0) <= {rules.class_limit} + {rules.class_slack}::DOUBLE / greatest(1, n_chars))
    AND (n_words < {rules.min_common} OR coalesce(w.d, 0) <= {rules.word_limit}) AS kept
  FROM base b LEFT JOIN dist{n} c ON c.rid = b.rid AND c.kind = 'class' LEFT JOIN dist{n} w ON w.rid = b.rid AND w.kind = 'word')"""

    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    CASE WHEN lang IN ({langs}) THEN lang ELSE 'other' END AS ref_lang FROM documents),
u AS MATERIALIZED (
  SELECT rid, ref_lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT rid, ref_lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
wins AS (
  SELECT rid, i, word || ' ' || lead(word) OVER doc || ' ' || lead(word, 2) OVER doc AS win
  FROM u WINDOW doc AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i FROM wins WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM again CROSS JOIN (VALUES (0), (1), (2)) AS three(o) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS MATERIALIZED (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM (
    SELECT d.rid, doc_id, ref_lang, coalesce(uw.n, 0) AS n_words, coalesce(uw.chars, 0) AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      length(text) AS n_all, strlen(text) - length(text) AS n_extra, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
      len(regexp_extract_all(text, '[0-9]')) AS n_digit, len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) AS n_marks,
      greatest(0, coalesce(uw.chars, 0) - n_upper - n_digit - n_marks - n_extra) AS n_lower,
      n_lower + n_upper + n_digit + n_all - coalesce(uw.chars, 0) + n_marks + n_extra AS n_chars
    FROM d LEFT JOIN (SELECT rid, count(*) AS n, sum(length(word)) AS chars FROM u GROUP BY rid) uw ON uw.rid = d.rid
    LEFT JOIN lines ON lines.rid = d.rid LEFT JOIN rep ON rep.rid = d.rid)),
listed(ref_lang, word, k) AS (VALUES {listed}),
common AS (
  SELECT rid, k, count(*) AS c FROM (SELECT rid, ref_lang, lower(word) AS word FROM u) JOIN listed USING (ref_lang, word) GROUP BY ALL),
hist AS MATERIALIZED (
  SELECT rid, 'class' AS kind, unnest(range(7)) AS k,
    unnest([n_lower, n_upper, n_digit, n_all - word_chars, n_marks - n_symbols, n_symbols, n_extra]) AS c FROM base
  UNION ALL
  SELECT b.rid, 'word', b.k, coalesce(common.c, 0) FROM (SELECT rid, unnest(range({width})) AS k FROM base) b LEFT JOIN common USING (rid, k)
  UNION ALL
  SELECT rid, 'word', {width}, n_words - coalesce(n, 0) FROM base LEFT JOIN (SELECT rid, sum(c) AS n FROM common GROUP BY rid) USING (rid)),
part AS MATERIALIZED (SELECT rid, kind, k, c / nullif(sum(c) OVER (PARTITION BY rid, kind), 0) AS p FROM hist),
{round_(1, 'NOT base_failed')},
{round_(2, 'rid IN (SELECT rid FROM kept1 WHERE kept)')}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept
FROM base JOIN kept2 USING (rid)"""


def codes_sql() -> str:
    """Lloyd rounds one after the other over (row, part, place) integers, for vectors of one
    length that the number of parts divides."""
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f""",
near{r} AS MATERIALIZED (
  SELECT rid, part, min(dist * {ENTRIES} + entry) AS best FROM (
    SELECT x.rid, x.part, b.entry, CAST(sum((x.x - b.c) * (x.x - b.c)) AS BIGINT) AS dist
    FROM x JOIN book{r} b USING (part, k) GROUP BY ALL) GROUP BY ALL)"""
        if r < ROUNDS:
            rounds += f""",
book{r + 1} AS MATERIALIZED (
  SELECT part, entry, k, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM book{r} LEFT JOIN (
    SELECT part, best % {ENTRIES} AS entry, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM x JOIN near{r} USING (rid, part) GROUP BY ALL) USING (part, entry, k))"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT rid, (i - 1) // (n // {PARTS}) AS part, (i - 1) % (n // {PARTS}) AS k, CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT rid, len(embedding) AS n, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM v)),
book0 AS MATERIALIZED (SELECT part, rid AS entry, k, x AS c FROM x WHERE rid < {ENTRIES}){rounds},
coded AS (
  SELECT rid, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, k)) FROM book{ROUNDS}) AS codebooks_sha256
FROM v JOIN coded USING (rid)"""
