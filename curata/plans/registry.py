"""How the modules of queries name their queries."""

from __future__ import annotations


class Registry(dict):
    """``name -> (query, SQL or None)``; used as a decorator."""

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            if name in self:
                raise ValueError(name)
            self[name] = (f, sql)
            return f

        return add
