"""Date and time functions: a time value, then modifiers from left to right. All in UTC."""

from __future__ import annotations

import re

from quarry.functions.base import MANY, function
from quarry.values import Expr, let, number, quoted, real_text, text

_FULL = r"^\\d{4}-\\d{2}-\\d{2}([ T]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)? *(Z|[+-]\\d{2}:\\d{2})?$"
_CLOCK = r"^\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)? *(Z|[+-]\\d{2}:\\d{2})?$"
_NUMBER = r"^ *[+-]?(\\d+\\.?\\d*|\\.\\d+) *$"


def _julian(sql: str) -> str:
    return f"timestamp_millis(CAST(round(({sql} - 2440587.5D) * 86400000D) AS BIGINT))"


def _parsed(sql: str) -> str:
    """Text as a timestamp, or NULL. A day up to 31 that the month doesn't have rolls into the next month."""
    month = "CAST(substring(s, 6, 2) AS INT)"
    day = "CAST(substring(s, 9, 2) AS INT)"
    rolled = (
        f"CASE WHEN {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND 31 THEN"
        f" try_cast(concat(CAST(date_add(make_date(CAST(substring(s, 1, 4) AS INT), {month}, 1), {day} - 1) AS STRING), substring(s, 11)) AS TIMESTAMP) END"
    )
    body = (
        f"CASE WHEN s RLIKE '{_FULL}' THEN coalesce(try_cast(s AS TIMESTAMP), {rolled})"
        f" WHEN s RLIKE '{_CLOCK}' THEN try_cast(concat('2000-01-01 ', s) AS TIMESTAMP)"
        f" WHEN lower(s) = 'now' THEN current_timestamp()"
        f" WHEN s RLIKE '{_NUMBER}' THEN {_julian('try_cast(s AS DOUBLE)')} END"
    )
    return let(sql, "s", body)


class Moment:
    """A timestamp under construction: its SQL, and whether a fraction of a second is to be shown."""

    def __init__(self, args: tuple[Expr, ...]):
        first, rest = (args[0], list(args[1:])) if args else (Expr("'now'", "text", "now", True), [])
        self.fraction = False
        later = next((i for i, m in enumerate(rest) if not m.literal), len(rest))
        words = [self._word(m) for m in rest[:later]]
        raw = number(first).sql if first.kind in ("int", "real") else None
        if raw is None and words and words[0] in ("unixepoch", "julianday", "auto"):
            raw = f"try_cast({text(first)} AS DOUBLE)"
        if raw is not None:
            how = words[0] if words else ""
            if how == "unixepoch":
                self.sql = f"timestamp_millis(CAST(round({raw} * 1000D) AS BIGINT))"
            elif how == "auto":
                self.sql = let(raw, "n", f"CASE WHEN n BETWEEN 0 AND 5373484.499999 THEN {_julian('n')} ELSE timestamp_millis(CAST(round(n * 1000D) AS BIGINT)) END")
            else:
                self.sql = _julian(f"CAST({raw} AS DOUBLE)")
            words = words[1:] if how in ("unixepoch", "julianday", "auto") else words
        elif first.kind == "time":
            self.sql = f"CAST({first.sql} AS TIMESTAMP)"
        elif first.literal and isinstance(first.value, str) and first.value.lower() in ("subsec", "subsecond"):
            self.sql, self.fraction = "current_timestamp()", True
        else:
            self.sql = _parsed(text(first))
        for w in words:
            self.apply(w)
        if later < len(rest):  # from the first modifier on that is known only at run time
            given = ", ".join(f"CAST({text(m)} AS STRING)" for m in rest[later:])
            self.sql = f"timestamp_millis(quarry_shift(unix_millis({self.sql}), array({given})))"

    @staticmethod
    def _word(m: Expr) -> str:
        return str(m.value).strip().lower() if m.value is not None else ""

    def apply(self, m: str) -> None:
        if m in ("utc", "localtime"):
            return
        if m in ("subsec", "subsecond"):
            self.fraction = True
        elif m in ("start of day", "start of month", "start of year"):
            self.sql = f"date_trunc('{m.split()[-1]}', {self.sql})"
        elif k := re.fullmatch(r"weekday ([0-6])(\.0*)?", m):
            self._day(lambda t: f"date_add(CAST({t} AS DATE), (({k[1]} - (dayofweek({t}) - 1)) + 7) % 7)")
        elif k := re.fullmatch(r"([+-]?\d+(?:\.\d*)?|[+-]?\.\d+) *(second|minute|hour|day|month|year)s?", m):
            self._shift(float(k[1]), k[2])
        elif k := re.fullmatch(r"([+-])?(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", m):
            seconds = (int(k[2]) * 3600 + int(k[3]) * 60 + float(k[4] or 0)) * (-1 if k[1] == "-" else 1)
            self._shift(seconds, "second")
        else:
            self.sql = "CAST(NULL AS TIMESTAMP)"

    def _day(self, date) -> None:
        """Replaces the date and keeps the time of day."""
        self.sql = let(self.sql, "t", f"timestampadd(MILLISECOND, unix_millis(t) - unix_millis(date_trunc('day', t)), CAST({date('t')} AS TIMESTAMP))")

    def _shift(self, n: float, unit: str) -> None:
        if unit in ("month", "year"):
            months = int(n) * (12 if unit == "year" else 1)
            self._day(lambda t: f"date_add(add_months(trunc({t}, 'MM'), {months}), day({t}) - 1)")
            n, unit = (n - int(n)) * (365 if unit == "year" else 30), "day"
        if n:
            ms = round(n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * 1000)
            self.sql = f"timestampadd(MILLISECOND, {ms}, {self.sql})"


@function("date", least=0, most=MANY)
def date(*args: Expr) -> Expr:
    return Expr(f"date_format({Moment(args).sql}, 'yyyy-MM-dd')", "text")


@function("time", least=0, most=MANY)
def time(*args: Expr) -> Expr:
    m = Moment(args)
    return Expr(f"date_format({m.sql}, 'HH:mm:ss{'.SSS' if m.fraction else ''}')", "text")


@function("datetime", least=0, most=MANY)
def datetime(*args: Expr) -> Expr:
    m = Moment(args)
    return Expr(f"date_format({m.sql}, 'yyyy-MM-dd HH:mm:ss{'.SSS' if m.fraction else ''}')", "text")


@function("julianday", least=0, most=MANY)
def julianday(*args: Expr) -> Expr:
    return Expr(f"(unix_millis({Moment(args).sql}) / 86400000D + 2440587.5D)", "real")


@function("unixepoch", least=0, most=MANY)
def unixepoch(*args: Expr) -> Expr:
    m = Moment(args)
    return Expr(f"(unix_millis({m.sql}) / 1000D)", "real") if m.fraction else Expr(f"unix_seconds({m.sql})", "int")


#: Each code as Spark SQL over the timestamp t.
CODES = {
    "d": "date_format(t, 'dd')", "e": "lpad(CAST(day(t) AS STRING), 2, ' ')", "f": "date_format(t, 'ss.SSS')", "F": "date_format(t, 'yyyy-MM-dd')",
    "G": "lpad(CAST(extract(YEAROFWEEK FROM t) AS STRING), 4, '0')", "g": "lpad(CAST(extract(YEAROFWEEK FROM t) % 100 AS STRING), 2, '0')",
    "V": "lpad(CAST(weekofyear(t) AS STRING), 2, '0')", "H": "date_format(t, 'HH')", "k": "lpad(CAST(hour(t) AS STRING), 2, ' ')",
    "I": "date_format(t, 'hh')", "l": "lpad(date_format(t, 'h'), 2, ' ')", "j": "date_format(t, 'DDD')", "m": "date_format(t, 'MM')", "M": "date_format(t, 'mm')",
    "p": "date_format(t, 'a')", "P": "lower(date_format(t, 'a'))", "R": "date_format(t, 'HH:mm')", "s": "CAST(unix_seconds(t) AS STRING)", "S": "date_format(t, 'ss')",
    "T": "date_format(t, 'HH:mm:ss')", "u": "CAST(weekday(t) + 1 AS STRING)", "w": "CAST(dayofweek(t) - 1 AS STRING)",
    "U": "lpad(CAST((dayofyear(t) + 6 - (dayofweek(t) - 1)) div 7 AS STRING), 2, '0')", "W": "lpad(CAST((dayofyear(t) + 6 - weekday(t)) div 7 AS STRING), 2, '0')",
    "Y": "date_format(t, 'yyyy')", "%": "'%'",
}


def _at_run_time(form: Expr, moment: str) -> Expr:
    """A format known only at run time: the text is cut at its codes and each is looked up among all codes' values."""
    codes = ", ".join(f"{quoted('%' + c)}, {sql}" for c, sql in CODES.items())
    pieces = f"regexp_extract_all({text(form)}, '(%.?|[^%]+)', 1)"
    body = f"aggregate({pieces}, '', (a, p) -> concat(a, CASE WHEN startswith(p, '%') THEN element_at(m, p) ELSE p END))"
    return Expr(let(moment, "t", f"CASE WHEN t IS NULL THEN NULL ELSE {let(f'map({codes})', 'm', body)} END"), "text")


@function("strftime", least=1, most=MANY)
def strftime(form: Expr, *args: Expr) -> Expr:
    if not (form.literal and isinstance(form.value, str)):
        return _at_run_time(form, Moment(args).sql)
    parts = []
    for m in re.finditer(r"%(.?)|[^%]+", form.value, re.S):
        if not m[0].startswith("%"):
            parts.append(quoted(m[0]))
        elif m[1] == "J":
            parts.append(real_text("unix_millis(t) / 86400000D + 2440587.5D"))
        elif m[1] in CODES:
            parts.append(CODES[m[1]])
        else:
            return Expr("CAST(NULL AS STRING)", "text")
    moment = Moment(args).sql
    return Expr(let(moment, "t", f"CASE WHEN t IS NULL THEN NULL ELSE concat({', '.join(parts) or quoted('')}) END"), "text")
