"""The table of scalar functions: name -> (fewest arguments, most, builder from Exprs to an Expr)."""

from __future__ import annotations

from collections.abc import Callable

from quarry.errors import NotFound, ParseError
from quarry.values import Expr

Builder = Callable[..., Expr]
TABLE: dict[str, tuple[int, int, Builder]] = {}
MANY = 99


def function(*names: str, least: int = 1, most: int | None = None):
    def add(f: Builder) -> Builder:
        for n in names:
            TABLE[n] = (least, least if most is None else most, f)
        return f

    return add


def build(name: str, args: list[Expr]) -> Expr:
    if name not in TABLE:
        raise NotFound(f"no such function: {name}")
    least, most, f = TABLE[name]
    if not least <= len(args) <= most:
        raise ParseError(f"wrong number of arguments to {name}()")
    return f(*args)
