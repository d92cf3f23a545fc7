"""Output modes of the shell: table, csv, json, line. Each takes column names and an iterator of rows."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from typing import Any


def cell(v: Any) -> str:
    """A value as the dialect shows it."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        text = f"{v:.15g}"
        if "e" in text:
            mantissa, e, exponent = text.partition("e")
            return f"{mantissa if '.' in mantissa else mantissa + '.0'}{e}{exponent}"
        return text if "." in text or "n" in text else text + ".0"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode(errors="replace")
    return str(v)


def as_table(columns: list[str], rows: Iterable) -> Iterator[str]:
    cells = [[cell(v) if v is not None else "NULL" for v in r] for r in rows]  # widths need all rows: the shell's mode
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    line = lambda left, mid, right: left + mid.join("─" * (w + 2) for w in widths) + right
    row = lambda r: "│" + "│".join(f" {x:<{w}} " for x, w in zip(r, widths, strict=True)) + "│"
    yield line("┌", "┬", "┐")
    yield row(columns)
    yield line("├", "┼", "┤")
    yield from map(row, cells)
    yield line("└", "┴", "┘")


def as_csv(columns: list[str], rows: Iterable) -> Iterator[str]:
    for r in [columns], rows:
        for x in r:
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow([cell(v) for v in x])
            yield out.getvalue()


def as_json(columns: list[str], rows: Iterable) -> Iterator[str]:
    plain = lambda v: bytes(v).decode(errors="replace") if isinstance(v, (bytes, bytearray)) else v if v is None or isinstance(v, (bool, int, float, str)) else str(v)
    first = True
    yield "["
    for r in rows:
        text = json.dumps(dict(zip(columns, map(plain, r), strict=True)), ensure_ascii=False, indent=2)
        yield ("" if first else ",\n") + "\n".join("  " + x for x in text.splitlines())
        first = False
    yield "]"


def as_lines(columns: list[str], rows: Iterable) -> Iterator[str]:
    for r in rows:
        yield "\n".join(f"{c} = {cell(v)}" for c, v in zip(columns, r, strict=True)) + "\n"


MODES = {"table": as_table, "csv": as_csv, "json": as_json, "line": as_lines}
