"""Keywords whose meaning depends on their neighbours in the same schema object.

A definition compiles its keyword's value and may ask for a neighbour's compiled
value; each keyword of an object is compiled once, whoever asks first, and a keyword
that ends up asking for itself is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from streamcontract.plans.dialects import SchemaError

#: f(keyword's value, need) -> compiled value; need(name) is a neighbour's, or None.
Definition = Callable[[object, Callable[[str], object]], object]


class Adjacent:
    """Definitions by keyword; a compiled value that can be called with an instance is a check and returns an error text or None."""

    def __init__(self, definitions: dict[str, Definition]) -> None:
        self.definitions = definitions

    def compile(self, schema: dict) -> dict[str, object]:
        """The compiled keywords of one schema object."""
        done: dict[str, object] = {}
        path: list[str] = []

        def need(name: str) -> object:
            if name not in schema or name not in self.definitions:
                return None
            if name in path:
                raise SchemaError(f"keywords need each other: {' -> '.join([*path[path.index(name) :], name])}", (name,))
            if name not in done:
                path.append(name)
                try:
                    done[name] = self.definitions[name](schema[name], need)
                finally:
                    path.pop()
            return done[name]

        return {k: need(k) for k in schema if k in self.definitions}

    def errors(self, schema: dict, instance: object) -> Iterator[str]:
        for check in self.compile(schema).values():
            if callable(check) and (found := check(instance)):
                yield found
