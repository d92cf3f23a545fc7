"""Numeric functions. What isn't a number gives NULL, and so does NaN."""

from __future__ import annotations

from quarry.functions.base import MANY, function
from quarry.values import Expr, as_kind, common, let, number


def _double(e: Expr) -> str:
    if e.kind == "text":
        return f"try_cast({e.sql} AS DOUBLE)"
    return f"CAST({number(e).sql} AS DOUBLE)" if e.kind != "blob" else "CAST(NULL AS DOUBLE)"


def _no_nan(sql: str) -> Expr:
    return Expr(let(sql, "y", "CASE WHEN isnan(y) THEN NULL ELSE y END"), "real")


@function("abs")
def absolute(x: Expr) -> Expr:
    n = number(x) if x.kind != "text" else Expr(_double(x), "real")
    return Expr(f"abs({n.sql})", n.kind)


@function("round", least=1, most=2)
def rounded(x: Expr, digits: Expr | None = None) -> Expr:
    d = "0" if digits is None else f"greatest(0, CAST({number(digits).sql} AS INT))"
    if digits is not None and digits.literal:
        d = str(max(0, int(digits.value or 0)))
        return Expr("CAST(NULL AS DOUBLE)" if digits.value is None else f"CAST(round({_double(x)}, {d}) AS DOUBLE)", "real")
    if digits is None:
        return Expr(f"CAST(round({_double(x)}, 0) AS DOUBLE)", "real")
    return Expr(f"CAST(format_string(concat('%.', {d}, 'f'), {_double(x)}) AS DOUBLE)", "real")


@function("sign")
def sign(x: Expr) -> Expr:
    return Expr(f"CAST(signum({_double(x)}) AS BIGINT)", "int")


def _one(spark: str):
    return lambda x: _no_nan(f"{spark}({_double(x)})")


for _names, _spark in ((("sqrt",), "sqrt"), (("exp",), "exp"), (("sin",), "sin"), (("cos",), "cos"), (("tan",), "tan"), (("asin",), "asin"), (("acos",), "acos"), (("atan",), "atan"), (("sinh",), "sinh"), (("cosh",), "cosh"), (("tanh",), "tanh"), (("asinh",), "asinh"), (("acosh",), "acosh"), (("atanh",), "atanh"), (("radians",), "radians"), (("degrees",), "degrees"), (("ln",), "ln"), (("log10",), "log10"), (("log2",), "log2")):
    function(*_names)(_one(_spark))


@function("log", least=1, most=2)
def log(a: Expr, b: Expr | None = None) -> Expr:
    """log(x) is to base 10, log(b, x) to base b."""
    return _no_nan(f"log10({_double(a)})" if b is None else f"log({_double(a)}, {_double(b)})")


def _whole(spark: str):
    return lambda x: Expr(f"CAST({spark}({_double(x)}) AS DOUBLE)", "real")


function("ceil", "ceiling")(_whole("ceil"))
function("floor")(_whole("floor"))


@function("trunc")
def trunc(x: Expr) -> Expr:
    return Expr(let(_double(x), "y", "CAST(CASE WHEN y < 0 THEN ceil(y) ELSE floor(y) END AS DOUBLE)"), "real")


@function("pow", "power", least=2)
def power(a: Expr, b: Expr) -> Expr:
    return _no_nan(f"power({_double(a)}, {_double(b)})")


@function("atan2", least=2)
def atan2(y: Expr, x: Expr) -> Expr:
    return _no_nan(f"atan2({_double(y)}, {_double(x)})")


@function("mod", least=2)
def mod(a: Expr, b: Expr) -> Expr:
    return Expr(f"({_double(a)} % nullif({_double(b)}, 0D))", "real")


@function("pi", least=0)
def pi() -> Expr:
    return Expr("pi()", "real")


@function("random", least=0)
def random() -> Expr:
    return Expr("xxhash64(uuid())", "int")


def _extreme(spark: str):
    def build(*args: Expr) -> Expr:
        kind = common([a.kind for a in args])
        values = [as_kind(a, kind) for a in args]
        missing = " OR ".join(f"{v} IS NULL" for v in values)
        return Expr(f"(CASE WHEN {missing} THEN NULL ELSE {spark}({', '.join(values)}) END)", kind)

    return build


function("scalar min", least=2, most=MANY)(_extreme("least"))
function("scalar max", least=2, most=MANY)(_extreme("greatest"))


@function("coalesce", least=2, most=MANY)
def coalesce(*args: Expr) -> Expr:
    kind = common([a.kind for a in args])
    return Expr(f"coalesce({', '.join(as_kind(a, kind) for a in args)})", kind)


@function("ifnull", least=2)
def ifnull(a: Expr, b: Expr) -> Expr:
    return coalesce(a, b)


@function("nullif", least=2)
def nullif(a: Expr, b: Expr) -> Expr:
    from quarry.values import compare

    return Expr(f"(CASE WHEN {compare('=', a, b).sql} THEN NULL ELSE {a.sql} END)", a.kind)


@function("iif", "if", least=2, most=3)
def iif(cond: Expr, yes: Expr, no: Expr | None = None) -> Expr:
    from quarry.values import literal, truth

    no = no or literal(None)
    kind = common([yes.kind, no.kind])
    return Expr(f"(CASE WHEN {truth(cond)} THEN {as_kind(yes, kind)} ELSE {as_kind(no, kind)} END)", kind)


@function("typeof")
def type_of(x: Expr) -> Expr:
    if x.kind == "null":
        return Expr("'null'", "text")
    label = {"int": "integer", "bool": "integer", "real": "real", "text": "text", "blob": "blob"}.get(x.kind, "text")
    return Expr(f"(CASE WHEN {x.sql} IS NULL THEN 'null' ELSE '{label}' END)", "text")


@function("bit_not")
def bit_not(x: Expr) -> Expr:
    return Expr(f"(~ CAST({number(x).sql} AS BIGINT))", "int")


