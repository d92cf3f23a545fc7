"""Syntax trees: one node class whose fields depend on its kind."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """kind and fields; equality is by content, so expressions can be compared with GROUP BY items."""

    def __init__(self, kind: str, **fields):
        self.kind = kind
        self.__dict__.update(fields)

    def __eq__(self, other) -> bool:
        return isinstance(other, Node) and self.__dict__ == other.__dict__

    def __hash__(self) -> int:
        return hash(repr(self))

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k != 'kind')})"

    def children(self) -> Iterator[Node]:
        for v in self.__dict__.values():
            yield from _nodes(v)

    def walk(self, into_queries: bool = False) -> Iterator[Node]:
        """This node and those below; queries inside expressions are entered only if asked."""
        yield self
        for c in self.children():
            if into_queries or c.kind not in ("query", "select"):
                yield from c.walk(into_queries)


def _nodes(v) -> Iterator[Node]:
    if isinstance(v, Node):
        yield v
    elif isinstance(v, (list, tuple)):
        for x in v:
            yield from _nodes(x)
