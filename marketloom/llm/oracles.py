"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

# Stand-ins for the marks that carry meaning. The regular expressions there have no look-behind, so what stands
# before a mark is kept by a group; decimal marks take two passes, as "1.2.3" has them overlap.
_MARK, _MINUS, _PLUS = "\x01", "\x02", "\x03"
_STEPS = (
    (r"(\p{N})[.,](\p{N})", rf"\1{_MARK}\2"),
    (r"(\p{N})[.,](\p{N})", rf"\1{_MARK}\2"),
    (r"(^|[^\p{L}\p{N}])[-−](\p{N})", rf"\1{_MINUS}\2"),
    (r"(^|[^\p{L}\p{N}])\+(\p{N})", rf"\1{_PLUS}\2"),
    (rf"[^\p{{L}}\p{{N}}\p{{M}}{_MARK}-{_PLUS}]+", ""),
)


def _plain(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for pattern, to in _STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


_GROUPS = f"""
WITH r AS (SELECT obs_id, coalesce(run_id, '') AS run_id, {_plain("market")} AS market, {_plain("selection")} AS selection,
    coalesce(CAST(TRY_CAST(replace(trim(odds), ',', '.') AS DECIMAL(38, 12)) AS VARCHAR), {_plain("odds")}) AS odds,
    regexp_extract_all(coalesce(heading_path, ''), '((?:"(?:[^"]|"")*"|[^">»→|;])+)', 1) AS parts FROM headerless_rows),
k AS (SELECT obs_id, run_id, market, selection, odds, list_sort(list_filter(list_transform(parts, lambda x: {_plain("x")}), lambda x: x <> '')) AS heading FROM r),
g AS (SELECT obs_id, MIN(obs_id) OVER (PARTITION BY run_id, market, selection, odds, heading) AS keep_obs_id FROM k)"""

ORACLES: dict[str, str] = {
    "p4_found": f"{_GROUPS} SELECT keep_obs_id, obs_id FROM g WHERE keep_obs_id < obs_id",
    "p4_copies": f"{_GROUPS} SELECT keep_obs_id, COUNT(*) AS copies FROM g GROUP BY keep_obs_id HAVING COUNT(*) > 1",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS said FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (said)""",
}
