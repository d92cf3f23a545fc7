"""Values of the dialect on Spark types: kinds, affinity, truth, comparison classes and text forms.

An Expr is a piece of Spark SQL with the kind of value it yields. Kinds are static (one a column); what the dialect
decides for each value at run time is decided here once for each expression.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import types as T

from quarry.errors import TypeMismatch


class Expr(NamedTuple):
    sql: str
    kind: str  # int, real, text, blob, bool, null; time for Spark's timestamps, other for what the dialect doesn't have
    value: Any = None  # of a literal
    literal: bool = False


#: Kinds by comparison class: numbers sort before text, text before blobs.
RANK = {"int": 1, "real": 1, "bool": 1, "text": 2, "blob": 3}


def affinity(declared: str) -> str:
    """Kind of a column by its declared type: the first substring that fits decides."""
    d = declared.upper()
    for part, kind in (("INT", "int"), ("CHAR", "text"), ("CLOB", "text"), ("TEXT", "text"), ("BLOB", "blob"), ("REAL", "real"), ("FLOA", "real"), ("DOUB", "real"), ("BOOL", "bool"), ("JSON", "text")):
        if part in d:
            return kind
    if any(x in d for x in ("DEC", "NUM")):
        return "real"
    return "int" if d and not any(x in d for x in ("DATE", "TIME")) else "text"


SPARK_TYPE = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "bool": T.BooleanType(), "null": T.StringType()}
SQL_TYPE = {"int": "BIGINT", "real": "DOUBLE", "text": "STRING", "blob": "BINARY", "bool": "BOOLEAN", "null": "STRING"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.BinaryType):
        return "blob"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "text" if isinstance(t, T.StringType) else "other"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


def literal(value: Any) -> Expr:
    if value is None:
        return Expr("NULL", "null", None, True)
    if isinstance(value, bool):
        return Expr("true" if value else "false", "bool", value, True)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            return literal(float(value))
        return Expr(f"{value}L" if value >= 0 else f"(-9223372036854775807L - 1L)" if value == -(2**63) else f"({value}L)", "int", value, True)
    if isinstance(value, float):
        if value != value:
            return literal(None)
        text = "CAST('Infinity' AS DOUBLE)" if value == float("inf") else "CAST('-Infinity' AS DOUBLE)" if value == float("-inf") else f"{value!r}D"
        return Expr(f"({text})", "real", value, True)
    if isinstance(value, (bytes, bytearray)):
        return Expr(f"X'{bytes(value).hex()}'", "blob", bytes(value), True)
    if isinstance(value, str):
        return Expr(quoted(value), "text", value, True)
    raise TypeMismatch(f"no SQL value for {type(value).__name__}")


def let(value: str, variable: str, body: str) -> str:
    """body with value computed once under the name variable."""
    return f"element_at(transform(array({value}), {variable} -> {body}), 1)"


def real_text(sql: str) -> str:
    """A real as text: 15 significant digits, no trailing zeros but always a decimal point, exponent form outside 1e-4 .. 1e15."""
    digits = "rtrim('0', replace(substring_index(s, 'e', 1), '.', ''))"
    body = (
        "CASE WHEN x = 0 THEN '0.0' WHEN x = CAST('Infinity' AS DOUBLE) THEN 'Inf' WHEN x = CAST('-Infinity' AS DOUBLE) THEN '-Inf' ELSE concat(CASE WHEN x < 0 THEN '-' ELSE '' END, "
        + let(
            "format_string('%.14e', abs(x))",
            "s",
            let(
                f"named_struct('d', {digits}, 'e', CAST(substring_index(s, 'e', -1) AS INT))",
                "p",
                "CASE WHEN p.e >= -4 AND p.e < 0 THEN concat('0.', repeat('0', -p.e - 1), p.d)"
                " WHEN p.e >= 0 AND p.e < 15 THEN concat(substring(rpad(p.d, greatest(p.e + 1, length(p.d)), '0'), 1, p.e + 1), '.', CASE WHEN length(p.d) > p.e + 1 THEN substring(p.d, p.e + 2) ELSE '0' END)"
                " ELSE concat(substring(p.d, 1, 1), '.', CASE WHEN length(p.d) > 1 THEN substring(p.d, 2) ELSE '0' END, 'e', CASE WHEN p.e < 0 THEN '-' ELSE '+' END, lpad(CAST(abs(p.e) AS STRING), greatest(2, length(CAST(abs(p.e) AS STRING))), '0')) END",
            ),
        )
        + ") END"
    )
    return let(f"CAST({sql} AS DOUBLE)", "x", body)


def text(e: Expr) -> str:
    """The value as text."""
    if e.kind == "text":
        return e.sql
    if e.kind == "real":
        return real_text(e.sql)
    if e.kind == "bool":
        return f"CAST(CAST({e.sql} AS INT) AS STRING)"
    if e.kind == "blob":
        return f"decode({e.sql}, 'UTF-8')"
    return f"CAST({e.sql} AS STRING)"


def number(e: Expr) -> Expr:
    """The value as an operand of arithmetic: text that is no number is an error at run time."""
    if e.kind in ("int", "real"):
        return e
    if e.kind == "bool":
        return Expr(f"CAST({e.sql} AS BIGINT)", "int")
    if e.kind == "null":
        return Expr("CAST(NULL AS BIGINT)", "int")
    return Expr(f"CAST({text(e)} AS DOUBLE)", "real")


def truth(e: Expr) -> str:
    """The value as a condition."""
    if e.kind == "bool":
        return e.sql
    if e.kind in ("int", "real"):
        return f"({e.sql} <> 0)"
    if e.kind == "blob":
        return f"(length({e.sql}) > 0)"
    if e.kind == "null":
        return "CAST(NULL AS BOOLEAN)"
    return f"(CASE WHEN {e.sql} IS NULL THEN NULL ELSE coalesce(try_cast({e.sql} AS DOUBLE) <> 0, false) END)"


def compare(op: str, a: Expr, b: Expr) -> Expr:
    """Comparison within a class as Spark has it; values of different classes compare by class alone."""
    ra, rb = RANK.get(a.kind), RANK.get(b.kind)
    if ra is None or rb is None or ra == rb:
        left, right = ((number(x).sql if x.kind == "bool" and y.kind != "bool" else x.sql) for x, y in ((a, b), (b, a)))
        return Expr(f"({left} {op} {right})", "bool")
    holds = {"=": False, "<>": True, "<": ra < rb, "<=": ra < rb, ">": ra > rb, ">=": ra > rb}[op]
    return Expr(f"(CASE WHEN {a.sql} IS NULL OR {b.sql} IS NULL THEN NULL ELSE {str(holds).lower()} END)", "bool")


def common(kinds: list[str]) -> str:
    """One kind for values of several: the only one, a number for numbers, otherwise text."""
    seen = {k for k in kinds if k != "null"}
    if not seen:
        return "null"
    if len(seen) == 1:
        return seen.pop()
    return ("real" if "real" in seen else "int") if seen <= {"int", "real", "bool"} else "text"


def as_kind(e: Expr, kind: str) -> str:
    if e.kind == kind or kind in ("null", "other"):
        return e.sql
    if e.kind == "null":
        return f"CAST(NULL AS {SQL_TYPE[kind]})"
    if kind == "text":
        return text(e)
    return f"CAST({e.sql} AS {SQL_TYPE[kind]})"
