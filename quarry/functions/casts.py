"""CAST in the dialect: the longest numeric prefix of a text counts, what has none is zero."""

from __future__ import annotations

from quarry.values import Expr, affinity, number, text, truth

_PREFIX = r"'^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)'"


def cast(e: Expr, declared: str) -> Expr:
    kind = affinity(declared)
    if declared.upper().startswith(("NUMERIC", "DECIMAL")):
        kind = "real" if e.kind != "int" else "int"
    if kind == "text":
        return Expr(text(e) if e.kind != "null" else "CAST(NULL AS STRING)", "text")
    if kind == "blob":
        return e if e.kind == "blob" else Expr(f"encode({text(e)}, 'UTF-8')", "blob")
    if kind == "bool":
        return Expr(truth(e), "bool")
    if e.kind == "null":
        return Expr(f"CAST(NULL AS {'BIGINT' if kind == 'int' else 'DOUBLE'})", kind)
    if e.kind in ("text", "blob"):
        real = f"coalesce(try_cast(regexp_extract({text(e)}, {_PREFIX}, 1) AS DOUBLE), CASE WHEN {e.sql} IS NOT NULL THEN 0D END)"
        if kind == "real":
            return Expr(real, "real")
        whole = f"try_cast(regexp_extract({text(e)}, '^\\\\s*([+-]?\\\\d+)', 1) AS BIGINT)"
        plain = rf"({text(e)} RLIKE '^\\s*[+-]?\\d+([^.eE0-9]|$)')"
        return Expr(f"(CASE WHEN {plain} AND {whole} IS NOT NULL THEN {whole} ELSE {_saturated(real)} END)", "int")
    n = number(e)
    if kind == "real":
        return Expr(f"CAST({n.sql} AS DOUBLE)", "real")
    return n if n.kind == "int" else Expr(_saturated(n.sql), "int")


def _saturated(real: str) -> str:
    """A real cut to a whole number, held at the ends of the range."""
    return f"(CASE WHEN {real} >= 9.223372036854775807E18D THEN 9223372036854775807L WHEN {real} <= -9.223372036854775808E18D THEN (-9223372036854775807L - 1L) ELSE CAST({real} AS BIGINT) END)"
