"""Registered queries for the finding pipeline (F1-F14) and the score
components (C1-C12), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog as C
from ..operators import findings as FN
from ..operators import scoring as SC
from ..operators.analyze import scan_and_score
from ..operators.detect import explode_fields, with_finding_steps, with_raw_findings
from . import oracle as O
from .queries import REGISTRY, scan_source
from .report_queries import ORACLES, reg

_SRC = f"SELECT chat_id, message_id, text, model_score FROM ({O.msgs_sql()}) m"
_AN = f"WITH {O.analysis_ctes(_SRC)}"


def _scored(spark, sf):
    return scan_and_score(scan_source(spark, sf))


# --- F1-F6 --------------------------------------------------------------------
@reg("scan_all", f"""{_AN}
SELECT chat_id, message_id, type, CAST(pos AS BIGINT) AS position, value, CAST(confidence AS DOUBLE) AS confidence FROM rf""")
def q_scan_all(spark, sf):
    df = with_raw_findings(scan_source(spark, sf))
    return explode_fields(df, KEYS, "raw_findings", {
        "type": lambda e: e["type"], "position": lambda e: e["pos"].cast("bigint"), "value": lambda e: e["value"],
        "confidence": lambda e: e["confidence"].cast("double")})


_STEPS_SQL = "\nUNION ALL\n".join(O.detector_select(d, "scan_src", steps=True) for d in C.DETECTORS)
_ST = f"WITH scan_src AS ({_SRC}), st AS ({_STEPS_SQL})"


KEYS = ["chat_id", "message_id"]


def _steps(spark, sf, fields):
    df = with_finding_steps(scan_source(spark, sf))
    base = {"type": lambda e: e["type"], "position": lambda e: e["pos"].cast("bigint")}
    return explode_fields(df, KEYS, "steps", {**base, **fields})


@reg("min_length_filter", f"""{_ST}
SELECT chat_id, message_id, type, CAST(pos AS BIGINT) AS position, v AS value, len_ok AS passes FROM st""")
def q_min_len(spark, sf):
    return _steps(spark, sf, {"value": lambda e: e["v"], "passes": lambda e: e["len_ok"]})


@reg("whitelist_filter", f"""{_ST}
SELECT chat_id, message_id, type, CAST(pos AS BIGINT) AS position, v AS value, wl_ok AS passes FROM st""")
def q_whitelist(spark, sf):
    return _steps(spark, sf, {"value": lambda e: e["v"], "passes": lambda e: e["wl_ok"]})


@reg("context_window", f"""{_ST}
SELECT chat_id, message_id, type, CAST(pos AS BIGINT) AS position, ctx AS context FROM st""")
def q_ctx(spark, sf):
    return _steps(spark, sf, {"context": lambda e: e["ctx"]})


@reg("context_boost", f"""{_ST}
SELECT chat_id, message_id, type, CAST(pos AS BIGINT) AS position, CAST(boost AS BIGINT) AS boost,
       CAST(confidence AS DOUBLE) AS confidence FROM st""")
def q_boost(spark, sf):
    return _steps(spark, sf, {"boost": lambda e: e["boost"].cast("bigint"),
                              "confidence": lambda e: e["confidence"].cast("double")})


@reg("finding_struct", f"""{_AN}
SELECT chat_id, message_id, type, value, CAST(confidence AS DOUBLE) AS confidence, CAST(severity AS DOUBLE) AS severity,
       CAST(pos AS BIGINT) AS position, CAST(priority AS BIGINT) AS priority FROM rf""")
def q_struct(spark, sf):
    df = with_raw_findings(scan_source(spark, sf))
    df = df.select(*KEYS, FN.public_findings(F.col("raw_findings")).alias("pub"))
    return explode_fields(df, KEYS, "pub", {
        "type": lambda e: e["type"], "value": lambda e: e["value"],
        "confidence": lambda e: e["confidence"].cast("double"), "severity": lambda e: e["severity"].cast("double"),
        "position": lambda e: e["position"].cast("bigint"), "priority": lambda e: e["priority"].cast("bigint")})


# --- F7-F14 -------------------------------------------------------------------
@reg("rank_findings", f"""{_AN}
SELECT s.chat_id, s.message_id,
       coalesce((SELECT string_agg(r.type || '@' || CAST(r.pos AS VARCHAR), ',' ORDER BY r.rank DESC, r.confidence DESC, r.det, r.pos)
                 FROM rf r WHERE r.chat_id = s.chat_id AND r.message_id = s.message_id), '') AS ranked
FROM scan_src s""")
def q_rank(spark, sf):
    df = with_raw_findings(scan_source(spark, sf))
    ranked = FN.rank_findings(F.col("raw_findings"))
    return df.select("chat_id", "message_id", F.array_join(F.transform(
        ranked, lambda f: F.concat(f["type"], F.lit("@"), f["pos"].cast("string"))), ",").alias("ranked"))


@reg("dedup_type", f"""{_AN}
SELECT chat_id, message_id, type, CAST(pos AS BIGINT) AS position, CAST(confidence AS DOUBLE) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY chat_id, message_id, type ORDER BY rank DESC, confidence DESC, det, pos) AS rn
  FROM rf) t WHERE rn = 1""")
def q_dedup_type(spark, sf):
    """F8 alone: the best-ranked finding of each type in a message (partial
    min_by per task, one shuffle on the message key)."""
    df = with_raw_findings(scan_source(spark, sf))
    ex = explode_fields(df, KEYS, "raw_findings", {
        "type": lambda e: e["type"], "v": lambda e: F.struct(e["pos"].alias("pos"), e["confidence"].alias("confidence")),
        "k": lambda e: F.struct(e["nrank"], e["nconf"], e["det"], e["pos"])})
    best = ex.groupBy("chat_id", "message_id", "type").agg(F.min_by("v", "k").alias("b"))
    return best.select("chat_id", "message_id", "type", F.col("b.pos").cast("bigint").alias("position"),
                       F.col("b.confidence").cast("double").alias("confidence"))


@reg("overlap_predicate", f"""{_AN}
SELECT chat_id, message_id, CAST(i AS BIGINT) AS idx, fl[i - 1].type AS type_a, fl[i].type AS type_b,
       CASE WHEN fl[i - 1].pos = 0 OR fl[i].pos = 0
            THEN fl[i - 1].grp = fl[i].grp AND abs(CAST(fl[i - 1].confidence AS DOUBLE) - CAST(fl[i].confidence AS DOUBLE)) < 0.3
            ELSE abs(fl[i - 1].pos - fl[i].pos) < 50 END AS overlaps
FROM (SELECT chat_id, message_id, fl, unnest(range(2, len(fl) + 1)) AS i FROM lists) t""")
def q_overlap(spark, sf):
    """F9 on each pair of neighbours in rank order (no all-pairs output)."""
    df = with_raw_findings(scan_source(spark, sf))
    r = df.select("chat_id", "message_id", FN.rank_findings(F.col("raw_findings")).alias("r"))
    idx = F.when(F.size("r") >= 2, F.sequence(F.lit(2), F.size("r"))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(idx, lambda i: F.struct(
        i.alias("idx"), F.element_at("r", i - 1).alias("a"), F.element_at("r", i).alias("b")))
    r = r.select(*KEYS, pairs.alias("pairs"))
    return explode_fields(r, KEYS, "pairs", {
        "idx": lambda p: p["idx"].cast("bigint"), "type_a": lambda p: p["a"]["type"], "type_b": lambda p: p["b"]["type"],
        "overlaps": lambda p: FN.overlaps(p["a"], p["b"])})


@reg("dedup_findings", f"""{_AN}
SELECT chat_id, message_id, CAST(fold_ord AS BIGINT) AS fold_ord, type, CAST(pos AS BIGINT) AS position,
       CAST(confidence AS DOUBLE) AS confidence, value FROM kept""")
def q_dedup(spark, sf):
    df = with_raw_findings(scan_source(spark, sf))
    et = df.schema["raw_findings"].dataType.simpleString()
    folded = df.select("chat_id", "message_id", FN.dedup_fold(FN.rank_findings(F.col("raw_findings")), et).alias("k"))
    ex = explode_fields(folded, KEYS, "k", {
        "type": lambda e: e["type"], "position": lambda e: e["pos"].cast("bigint"),
        "confidence": lambda e: e["confidence"].cast("double"), "value": lambda e: e["value"]}, pos_name="fold_ord")
    return ex.withColumn("fold_ord", F.col("fold_ord").cast("bigint"))


@reg("order_by_position", f"""{_AN}
SELECT chat_id, message_id, CAST(ord - 1 AS BIGINT) AS ord, type, CAST(pos AS BIGINT) AS position FROM kept""")
def q_order(spark, sf):
    s = _scored(spark, sf)
    ex = explode_fields(s, KEYS, "findings", {
        "type": lambda e: e["type"], "position": lambda e: e["pos"].cast("bigint")}, pos_name="ord")
    return ex.withColumn("ord", F.col("ord").cast("bigint"))


@reg("dedup_stats", f"""{_AN}
SELECT chat_id, CAST(sum(n_raw) AS BIGINT) AS n_raw, CAST(sum(n_kept) AS BIGINT) AS n_kept FROM scored GROUP BY chat_id""")
def q_stats(spark, sf):
    s = _scored(spark, sf)
    return s.groupBy("chat_id").agg(F.sum(F.size("raw_findings")).cast("bigint").alias("n_raw"),
                                    F.sum(F.size("findings")).cast("bigint").alias("n_kept"))


def _type_case(mapping: dict, default_self: bool) -> str:
    whens = " ".join(f"WHEN {O.q(k)} THEN {O.q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CASE type {whens} ELSE {'type' if default_self else '0'} END"


_TYPES_SQL = f"""{_AN}, types AS (SELECT DISTINCT type FROM rf UNION SELECT DISTINCT event_type AS type FROM events)"""


def _types(spark, sf):
    from . import fixtures as FX
    df = with_raw_findings(scan_source(spark, sf))
    t1 = explode_fields(df, [], "raw_findings", {"type": lambda e: e["type"]})
    t2 = FX.table(spark, sf, "events").select(F.col("event_type").alias("type"))
    return t1.union(t2).distinct()


@reg("type_group", f"""{_TYPES_SQL}
SELECT type, {_type_case(C.TYPE_GROUP, True)} AS grp FROM types""")
def q_type_group(spark, sf):
    return _types(spark, sf).select("type", FN.type_group_col(F.col("type")).alias("grp"))


@reg("type_rank", f"""{_TYPES_SQL}
SELECT type, CAST({_type_case(C.TYPE_RANK, False)} AS INTEGER) AS rank FROM types""")
def q_type_rank(spark, sf):
    return _types(spark, sf).select("type", FN.type_rank_col(F.col("type")).cast("int").alias("rank"))


# --- C1-C12 -------------------------------------------------------------------
_CJ = f"""{_AN}, comp AS (
  SELECT s.chat_id, s.message_id, s.text, s.model_eff, coalesce(a.n_kept, 0) AS n, coalesce(a.n_types, 0) AS n_types,
         coalesce(a.max_conf, 0) AS max_conf, coalesce(a.n_cat, 0) AS n_cat, coalesce(a.wsum, 0) AS wsum,
         coalesce(a.has_mail, FALSE) AS has_mail, coalesce(a.has_pass, FALSE) AS has_pass
  FROM (SELECT chat_id, message_id, text,
               CASE WHEN {O.BLANK} THEN CAST(0 AS DECIMAL(5,3)) ELSE CAST(coalesce(model_score, 0) AS DECIMAL(5,3)) END AS model_eff
        FROM scan_src) s
  LEFT JOIN agg a ON a.chat_id = s.chat_id AND a.message_id = s.message_id),
comp2 AS (
  SELECT *, CASE WHEN n_cat >= 3 THEN 0.40 WHEN n_cat >= 2 THEN 0.25 ELSE 0.00 END AS cat_bonus,
            CASE WHEN has_mail AND n_cat >= 2 THEN 0.15 ELSE 0.00 END AS mail_bonus,
            least(0.45, (n - 1) * 0.09) AS count_bonus,
            (CASE WHEN n = 0 THEN 0.20 WHEN has_pass THEN 0.40 ELSE 0.35 END)
              * (CASE WHEN coalesce(length(text), 0) < 20 THEN 0.7 ELSE 1.0 END) AS model_weight,
            CASE WHEN has_pass AND model_eff > 0.8 THEN 0.22 ELSE 0.00 END AS doc_bonus
  FROM comp),
comp3 AS (SELECT *, CAST(least(1, greatest(0, max_conf * 0.50 + wsum * 0.30 + cat_bonus + mail_bonus + count_bonus)) AS DECIMAL(12,6)) AS regex_score FROM comp2)"""


def _components(spark, sf):
    s = _scored(spark, sf)
    f = F.col("findings")
    n = SC.n_findings(f)
    n_cat = SC.distinct_categories(f)
    tl = F.coalesce(F.length("text"), F.lit(0))
    return s.select(
        "chat_id", "message_id",
        ((n == 0) & (F.col("model_score_eff") < 0.5)).alias("zero_rule"),
        SC.distinct_types(f).cast("bigint").alias("n_types"),
        SC.max_confidence(f).cast("double").alias("max_conf"),
        n_cat.cast("bigint").alias("n_cat"),
        SC.weighted_sum(f).cast("double").alias("wsum"),
        SC.category_bonus(n_cat).cast("double").alias("cat_bonus"),
        SC.free_mail_bonus(f, n_cat).cast("double").alias("mail_bonus"),
        SC.count_bonus(n).cast("double").alias("count_bonus"),
        SC.regex_score(f).cast("double").alias("regex_score"),
        SC.model_weight(f, tl).cast("double").alias("model_weight"),
        SC.document_bonus(f, F.col("model_score_eff")).cast("double").alias("doc_bonus"),
        F.col("sx_score"))


_COMPONENTS = [
    ("score_zero_rule", "zero_rule", "n = 0 AND model_eff < 0.5"),
    ("distinct_types", "n_types", "CAST(n_types AS BIGINT)"),
    ("max_confidence", "max_conf", "CAST(max_conf AS DOUBLE)"),
    ("distinct_categories", "n_cat", "CAST(n_cat AS BIGINT)"),
    ("weighted_sum", "wsum", "CAST(wsum AS DOUBLE)"),
    ("category_bonus", "cat_bonus", "CAST(cat_bonus AS DOUBLE)"),
    ("free_mail_bonus", "mail_bonus", "CAST(mail_bonus AS DOUBLE)"),
    ("count_bonus", "count_bonus", "CAST(count_bonus AS DOUBLE)"),
    ("regex_score", "regex_score", "CAST(regex_score AS DOUBLE)"),
    ("model_weight", "model_weight", "CAST(model_weight AS DOUBLE)"),
    ("document_bonus", "doc_bonus", "CAST(doc_bonus AS DOUBLE)"),
]


def _component_query(col):
    def fn(spark, sf):
        return _components(spark, sf).select("chat_id", "message_id", col)
    return fn


for _key, _col, _expr in _COMPONENTS:
    REGISTRY[_key] = _component_query(_col)
    ORACLES[_key] = f"{_CJ}\nSELECT chat_id, message_id, {_expr} AS {_col} FROM comp3"

REGISTRY["final_score"] = _component_query("sx_score")
ORACLES["final_score"] = f"{_AN}\nSELECT chat_id, message_id, sx_score FROM scored"
