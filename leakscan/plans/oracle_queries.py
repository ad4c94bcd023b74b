"""DuckDB SQL for each registered query (same column names)."""

from __future__ import annotations

from .. import catalog as C
from .oracle import analysis_ctes, detector_select, msgs_sql

ORACLES: dict = {}


def _scan_src() -> str:
    return f"SELECT chat_id, message_id, text, model_score FROM ({msgs_sql()}) m"


ORACLES["scan_score"] = f"""
WITH {analysis_ctes(_scan_src())}
SELECT chat_id, message_id, CAST(n_raw AS BIGINT) AS n_raw, CAST(n_kept AS BIGINT) AS n_kept,
       leaks, sx_score
FROM scored
"""

for _d in C.DETECTORS:
    ORACLES[f"detect_{_d.name}"] = f"""
WITH scan_src AS ({_scan_src()})
SELECT chat_id, message_id, CAST(pos AS BIGINT) AS position, v AS full_value, value,
       CAST(confidence AS DOUBLE) AS confidence
FROM ({detector_select(_d, 'scan_src')}) f
"""

