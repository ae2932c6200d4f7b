"""DuckDB SQL for the stand-in views and helpers to build oracle queries.

The oracle is an independent formulation of each query in plain SQL over the
same parquet tables; it is what the Spark plans are checked against.
"""

from __future__ import annotations

from collections.abc import Sequence

VIEWS = {
    "v1": """v1 AS (
  SELECT conv_id AS id, turn AS seq,
         CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS INTEGER) AS speaker,
         text,
         CAST(SUM(50 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 50 * length(text) AS BIGINT) AS start_ms,
         CAST(SUM(50 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_ms
  FROM conversations)""",
    "v2": """v2 AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS id,
         list(event_type ORDER BY ts, event_id) AS symptom
  FROM events GROUP BY 1)""",
    "v3": """v3 AS (
  SELECT user_id AS id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
         value / (value + 50.0) AS p,
         CAST(user_id % 3 AS INTEGER) AS label1,
         CAST(user_id % 3 = 1 AS INTEGER) AS y,
         event_type
  FROM events)""",
    "v3t": """v3t AS (
  SELECT id, seq, seq * 1000 AS start_ms, seq * 1000 + 900 AS end_ms FROM v3 WHERE event_type <> 'view')""",
    "v4": """v4 AS (
  SELECT d.doc_id AS id, round((d.n_chars % 1000) / 1000.0, 3) AS p, CAST(l.quality AS INTEGER) AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "v5": """v5 AS (
  SELECT vec_id AS id, CAST(t.pos AS INTEGER) AS pos, (vec_id + t.pos) % 5 = 0 AS is_marker,
         CAST(embedding[4 * t.pos + 2] AS DOUBLE) AS l0,
         CAST(embedding[4 * t.pos + 3] AS DOUBLE) AS l1,
         CAST(embedding[4 * t.pos + 4] AS DOUBLE) AS l2,
         CAST(label % 3 AS INTEGER) AS label
  FROM embeddings, range(16) t(pos))""",
}

# views other views depend on
_DEPS = {"v3t": ["v3"]}


def sql(views: Sequence[str], ctes: Sequence[str] = (), select: str = "",
        round6: Sequence[str] = ()) -> str:
    """``WITH <views>, <ctes> <select>``; ``round6`` columns are rounded to 6 dp."""
    names: list[str] = []
    for v in views:
        for d in _DEPS.get(v, []):
            if d not in names:
                names.append(d)
        if v not in names:
            names.append(v)
    parts = [VIEWS[v] for v in names] + list(ctes)
    body = (("WITH " + ",\n".join(parts) + "\n") if parts else "") + select
    if round6:
        rep = ", ".join(f"round({c}, 6) AS {c}" for c in round6)
        body = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS q"
    return body


def auroc_ap_ctes(src: str, group: Sequence[str] = (), p: str = "p", y: str = "y",
                  prefix: str = "r") -> list[str]:
    """CTEs computing exact AUROC / AP of ``src`` into ``{prefix}_rank``."""
    g = ", ".join(group)
    gsel = (g + ", ") if group else ""
    part = f"PARTITION BY {g} " if group else ""
    join = (" USING (" + g + ")") if group else " ON TRUE"
    return [
        f"""{prefix}_cnt AS (SELECT {gsel}{p} AS p, SUM(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS pos,
              SUM(CASE WHEN {y} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY {gsel}{p})""",
        f"""{prefix}_cum AS (SELECT *, SUM(pos) OVER ({part}ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
              SUM(neg) OVER ({part}ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
              FROM {prefix}_cnt)""",
        f"""{prefix}_tot AS (SELECT {gsel}SUM(pos) AS n_pos, SUM(neg) AS n_neg FROM {prefix}_cnt {"GROUP BY " + g if group else ""})""",
        f"""{prefix}_rank AS (SELECT {gsel}
              SUM(pos * ((t.n_neg - fp) + neg / 2.0)) / (MAX(t.n_pos) * MAX(t.n_neg)) AS auroc,
              SUM(pos * tp / (tp + fp)) / MAX(t.n_pos) AS ap
              FROM {prefix}_cum c JOIN {prefix}_tot t{join} {"GROUP BY " + g if group else ""})""",
    ]


def div0(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def binary_metrics_cte(src: str, name: str, threshold: str, group: Sequence[str] = (),
                       p: str = "p", y: str = "y") -> str:
    g = ", ".join(group)
    gsel = (g + ", ") if group else ""
    return f"""{name}_c AS (SELECT {gsel}
      CAST(SUM(CASE WHEN {p} >= {threshold} AND {y} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
      CAST(SUM(CASE WHEN {p} >= {threshold} AND {y} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
      CAST(SUM(CASE WHEN {p} < {threshold} AND {y} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
      CAST(SUM(CASE WHEN {p} < {threshold} AND {y} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
      AVG(power({p} - CASE WHEN {y} = 1 THEN 1.0 ELSE 0.0 END, 2)) AS brier
      FROM {src} {"GROUP BY " + g if group else ""}),
    {name} AS (SELECT {gsel}tn, fp, fn, tp,
      {div0('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
      {div0('tp', 'tp + fp')} AS precision,
      {div0('tp', 'tp + fn')} AS recall,
      {div0('tn', 'tn + fp')} AS specificity,
      {div0('2 * tp', '2 * tp + fp + fn')} AS f1,
      {div0('tn', 'tn + fn')} AS npv,
      {div0('fp', 'fp + tp')} AS fdr,
      brier FROM {name}_c)"""


METRIC_DOUBLES = ["accuracy", "precision", "recall", "specificity", "f1", "npv", "fdr", "brier"]


def u_sql(seed: str, key: str) -> str:
    """DuckDB form of ``functions.uniform_hash``; ``seed`` is a SQL expression."""
    return (f"(CAST('0x' || substr(md5(CAST({seed} AS VARCHAR) || ':' || CAST({key} AS VARCHAR)), 1, 13) "
            f"AS UBIGINT) / 4503599627370496.0)")


V2_LABELS = """v2l AS (
  SELECT id, symptom,
    coalesce(list_contains(symptom, 'error'), false) AS label,
    CAST(CASE WHEN coalesce(list_contains(symptom, 'error'), false) THEN 1
         WHEN coalesce(list_has_any(symptom, ['purchase']), false)
              OR len(list_filter(symptom, lambda x: list_contains(['click', 'view'], x))) >= 2
              OR len(list_filter(symptom, lambda x: list_contains(['signup', 'view'], x))) >= 2 THEN 2
         ELSE 0 END AS INTEGER) AS label1,
    coalesce(list_has_any(symptom, ['purchase', 'signup']), false) AS label2
  FROM v2)"""
VIEWS["v2l"] = V2_LABELS
_DEPS["v2l"] = ["v2"]
