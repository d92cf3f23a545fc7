"""String and blob functions."""

from __future__ import annotations

import re

from quarry.errors import Unsupported
from quarry.functions.base import MANY, function
from quarry.values import Expr, let, number, quoted, real_text, text


def _int(e: Expr) -> str:
    return f"CAST({number(e).sql} AS INT)"


@function("length")
def length(x: Expr) -> Expr:
    return Expr(f"CAST(length({x.sql if x.kind == 'blob' else text(x)}) AS BIGINT)", "int")


@function("upper")
def upper(x: Expr) -> Expr:
    return Expr(f"upper({text(x)})", "text")


@function("lower")
def lower(x: Expr) -> Expr:
    return Expr(f"lower({text(x)})", "text")


@function("substr", "substring", least=2, most=3)
def substr(s: Expr, start: Expr, count: Expr | None = None) -> Expr:
    """1-based; a negative start counts from the end, a negative count takes characters before the start."""
    subject = s.sql if s.kind == "blob" else text(s)
    plain = start.literal and isinstance(start.value, int) and start.value > 0 and (count is None or count.literal and isinstance(count.value, int) and count.value >= 0)
    if plain:
        return Expr(f"substring({subject}, {start.value}{'' if count is None else f', {count.value}'})", s.kind if s.kind == "blob" else "text")
    given = f"named_struct('s', {subject}, 'a', {_int(start)}, 'n', {_int(count) if count else '2147483647'})"
    p0 = "CASE WHEN v.a > 0 THEN v.a - 1 WHEN v.a < 0 THEN length(v.s) + v.a ELSE -1 END"
    span = let(
        f"named_struct('p', CAST({p0} AS BIGINT), 'n', CAST(v.n AS BIGINT), 'l', CAST(length(v.s) AS BIGINT))",
        "w",
        let(
            "named_struct('lo', greatest(0L, least(w.l, CASE WHEN w.n < 0 THEN w.p + w.n ELSE w.p END)), 'hi', greatest(0L, least(w.l, CASE WHEN w.n < 0 THEN w.p ELSE w.p + w.n END)))",
            "r",
            "substring(v.s, CAST(r.lo + 1 AS INT), CAST(r.hi - r.lo AS INT))",
        ),
    )
    return Expr(let(given, "v", f"CASE WHEN v.s IS NULL OR v.a IS NULL OR v.n IS NULL THEN NULL ELSE {span} END"), s.kind if s.kind == "blob" else "text")


@function("replace", least=3)
def replace(s: Expr, old: Expr, new: Expr) -> Expr:
    return Expr(f"replace({text(s)}, {text(old)}, {text(new)})", "text")


def _trim(side: str):
    def build(s: Expr, chars: Expr | None = None) -> Expr:
        return Expr(f"{side}({text(s)})" if chars is None else f"trim({ {'ltrim': 'LEADING', 'rtrim': 'TRAILING', 'trim': 'BOTH'}[side] } {text(chars)} FROM {text(s)})", "text")

    return build


for _side in ("trim", "ltrim", "rtrim"):
    function(_side, least=1, most=2)(_trim(_side))


@function("instr", least=2)
def instr(s: Expr, part: Expr) -> Expr:
    return Expr(f"CAST(instr({text(s)}, {text(part)}) AS BIGINT)", "int")


@function("hex")
def hexed(x: Expr) -> Expr:
    return Expr(f"hex({x.sql if x.kind == 'blob' else text(x)})", "text")


@function("char", least=1, most=MANY)
def char(*codes: Expr) -> Expr:
    one = [f"decode(unhex(lpad(hex(CAST({number(c).sql} AS BIGINT)), 8, '0')), 'UTF-32')" for c in codes]
    return Expr(f"concat({', '.join(one)})", "text")


@function("unicode")
def code_point(s: Expr) -> Expr:
    return Expr(f"CAST(nullif(ascii({text(s)}), 0) AS BIGINT)", "int")


@function("quote")
def quote(x: Expr) -> Expr:
    if x.kind == "null":
        return Expr("'NULL'", "text")
    if x.kind == "blob":
        body = f"concat('X\\'', hex({x.sql}), '\\'')"
    elif x.kind == "text":
        body = f"concat('\\'', replace({x.sql}, '\\'', '\\'\\''), '\\'')"
    else:
        body = text(x)
    return Expr(f"coalesce({body}, 'NULL')", "text")


@function("zeroblob")
def zeroblob(n: Expr) -> Expr:
    return Expr(f"unhex(repeat('00', {_int(n)}))", "blob")


@function("randomblob")
def randomblob(n: Expr) -> Expr:
    return Expr(f"substring(unhex(array_join(transform(sequence(1, greatest(1, CAST(ceil({number(n).sql} / 32.0D) AS INT))), i -> sha2(concat(uuid(), i), 256)), '')), 1, greatest(1, {_int(n)}))", "blob")


def glob_pattern(pattern: str) -> str:
    """The regular expression of a glob: * ? [...] and [^...], case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))) > 0:
            body = pattern[i + 1 : end]
            negated, body = body.startswith("^"), body.removeprefix("^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&^~])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return f"(?s)\\A{''.join(out)}\\z"


@function("glob", least=2)
def glob(pattern: Expr, s: Expr) -> Expr:
    if pattern.literal and isinstance(pattern.value, str):
        return Expr(f"({text(s)} RLIKE {quoted(glob_pattern(pattern.value))})", "bool")
    # A pattern known only at run time: quote what is special to regular expressions, then translate the glob signs.
    escaped = f"regexp_replace({text(pattern)}, '([.+(){{}}|$\\\\\\\\])', '\\\\\\\\$1')"
    regex = f"concat('(?s)\\\\A', replace(replace({escaped}, '*', '.*'), '?', '.'), '\\\\z')"
    return Expr(f"({text(s)} RLIKE {regex})", "bool")


def like(s: Expr, pattern: Expr, escape: Expr | None = None, fold: bool = True) -> Expr:
    """% and _; letters match without regard to case. A backslash is an ordinary character."""
    if escape is not None and not (escape.literal and isinstance(escape.value, str) and len(escape.value) == 1):
        raise Unsupported("ESCAPE that isn't one character")
    if pattern.literal and isinstance(pattern.value, str):
        p = pattern.value
        if escape is None or escape.value == "\\":
            p = p.replace("\\", "\\\\") if escape is None else p
        else:
            p = re.sub(re.escape(escape.value) + "(.)|(\\\\)", lambda m: "\\" + m[1] if m[1] and m[1] in "%_\\" else m[1] if m[1] else "\\\\", p)
        right = quoted(p)
    else:
        right = f"replace({text(pattern)}, '\\\\', '\\\\\\\\')"
    return Expr(f"({text(s)} {'ILIKE' if fold else 'LIKE'} {right})", "bool")


@function("like", least=2, most=3)
def like_function(pattern: Expr, s: Expr, escape: Expr | None = None) -> Expr:
    return like(s, pattern, escape)


_CONVERSION = re.compile(r"%([-0 +#,!]*)(\*|\d*)(?:\.(\*|\d+))?(?:ll|l|h)?(.)", re.S)


@function("printf", "format", least=1, most=MANY)
def printf(form: Expr, *args: Expr) -> Expr:
    """Conversions d i u x X o c s f e E g G and %; a missing argument is 0 or empty, an unknown conversion stands for itself."""
    stars = isinstance(form.value, str) and "*" in form.value and not all(a.literal for a in args)
    if not (form.literal and isinstance(form.value, str)) or stars:
        given = ", ".join(f"CAST({text(a)} AS STRING)" for a in args)
        return Expr(f"quarry_printf({text(form)}, CAST(array({given}) AS ARRAY<STRING>))", "text")
    parts, at, rest = [], 0, list(args)

    def pull(default: Expr) -> Expr:
        return rest.pop(0) if rest else default

    for m in _CONVERSION.finditer(form.value):
        if m.start() > at:
            parts.append(quoted(form.value[at : m.start()]))
        at = m.end()
        flags, width, precision, c = m[1], m[2], m[3], m[4]
        if c == "%":
            parts.append("'%'")
            continue
        if c not in "diuxXocsfeEgGqQ":
            parts.append(quoted(m[0]))
            continue
        if width == "*":
            width = str(int(pull(Expr("0", "int", 0, True)).value or 0))
            if width.startswith("-"):
                flags, width = flags + "-", width[1:]
        if precision == "*":
            precision = str(int(pull(Expr("0", "int", 0, True)).value or 0))
        if c in "diuxXo":
            parts.append(_padded(_integer(pull(Expr("0L", "int", 0, True)), c, flags, precision), width, flags, numeric=precision is None))
        elif c in "feEgG":
            parts.append(_padded(_real(pull(Expr("0.0D", "real", 0.0, True)), c, flags, precision), width, flags, numeric=True))
        elif c in "qQ":
            arg = pull(Expr("''", "text", "", True))
            body = f"replace({text(arg)}, '\\'', '\\'\\'')"
            parts.append(f"coalesce({body}, '(NULL)')" if c == "q" else quote(arg).sql)
        else:
            body = f"coalesce({text(pull(Expr(chr(39) * 2, 'text', '', True)))}, '')"
            if c == "c":
                body = f"substring({body}, 1, 1)"
            elif precision is not None:
                body = f"substring({body}, 1, {int(precision)})"
            parts.append(_padded(body, width, flags, numeric=False))
    if at < len(form.value):
        parts.append(quoted(form.value[at:]))
    return Expr(f"concat({', '.join(parts)})" if parts else "''", "text")


def _integer(e: Expr, c: str, flags: str, precision: str | None) -> str:
    value = number(Expr(f"coalesce({e.sql}, 0)", e.kind if e.kind != "null" else "int"))
    v = f"CAST({value.sql} AS BIGINT)"
    if c in "xX":
        digits = f"{'upper' if c == 'X' else 'lower'}(hex({v}))"
        digits = f"concat('0{c}', {digits})" if "#" in flags else digits
        return digits
    if c == "o":
        return f"concat({quoted('0') if '#' in flags else quoted('')}, conv(hex({v}), 16, 8))"
    digits = f"regexp_replace(CAST({v} AS STRING), '^-', '')"
    if c == "u":
        return f"conv(hex({v}), 16, 10)"
    if precision is not None:
        digits = let(digits, "d", f"lpad(d, greatest(length(d), {int(precision)}), '0')")
    if "," in flags:
        digits = f"regexp_replace({digits}, '(?<=\\\\d)(?=(\\\\d{{3}})+$)', ',')"
    plus = "+" if "+" in flags else " " if " " in flags else ""
    return f"concat(CASE WHEN {v} < 0 THEN '-' ELSE {quoted(plus)} END, {digits})"


def _real(e: Expr, c: str, flags: str, precision: str | None) -> str:
    value = number(Expr(f"coalesce({e.sql}, 0)", e.kind if e.kind != "null" else "int"))
    v = f"CAST({value.sql} AS DOUBLE)"
    plus = "+" if "+" in flags else " " if " " in flags else ""
    sign = f"CASE WHEN {v} < 0 THEN '-' ELSE {quoted(plus)} END"
    p = 6 if precision is None else int(precision)
    comma = "," if "," in flags else ""
    if c == "f":
        return f"concat({sign}, format_string('%{comma}.{p}f', abs({v})))"
    if c in "eE":
        return f"concat({sign}, format_string('%.{p}{c}', abs({v})))"
    p = max(1, p)
    e_text = f"format_string('%.{p - 1}e', abs({v}))"
    strip = (lambda s: s) if "#" in flags else (lambda s: f"CASE WHEN {s} LIKE '%.%' THEN regexp_replace({s}, '[.]?0+$', '') ELSE {s} END")
    fixed = f"format_string(concat('%.', greatest(0, {p - 1} - x), 'f'), abs({v}))"
    small = let(fixed, "f", strip("f"))
    large = let("substring_index(t, 'e', 1)", "m", f"concat({strip('m')}, 'e', substring_index(t, 'e', -1))")
    body = let(e_text, "t", let("CAST(substring_index(t, 'e', -1) AS INT)", "x", f"CASE WHEN {v} = 0 THEN '0' WHEN x < -4 OR x >= {p} THEN {large} ELSE {small} END"))
    return f"concat({sign}, {f'upper({body})' if c == 'G' else body})"


def _padded(body: str, width: str, flags: str, numeric: bool) -> str:
    if not width or int(width) == 0:
        return body
    w = int(width)
    if "-" in flags:
        return let(body, "b", f"rpad(b, greatest(length(b), {w}), ' ')")
    if "0" in flags and numeric:
        return let(body, "b", f"concat(regexp_extract(b, '^[-+ ]?', 0), lpad(regexp_replace(b, '^[-+ ]', ''), greatest(length(regexp_replace(b, '^[-+ ]', '')), {w} - length(regexp_extract(b, '^[-+ ]?', 0))), '0'))")
    return let(body, "b", f"lpad(b, greatest(length(b), {w}), ' ')")


__all__ = ["glob_pattern", "like", "real_text"]
