"""Scope predicates: declarative filters over sessions, compiled to one Column."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Values of one dimension are alternatives; dimensions are joined by AND. None or empty: no condition."""

    topics: tuple = ()
    tags: tuple = ()
    files: tuple = ()
    sources: tuple = ()
    sessions: tuple = ()
    since: str | None = None
    until: str | None = None

    def parts(self) -> list[Column]:
        any_of = lambda c, values: F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, values))), F.lit(False))
        found = []
        if self.topics:
            found.append(any_of("topics", self.topics))
        if self.tags:
            found.append(any_of("user_tags", self.tags))
        if self.files:
            starts = lambda f: reduce(lambda a, b: a | b, [F.lower(f).startswith(p.lower()) for p in self.files])
            found.append(F.coalesce(F.exists("files_mentioned", starts), F.lit(False)))
        if self.sources:
            found.append(F.col("source").isin(*self.sources))
        if self.since:
            found.append(F.coalesce(F.col("created_at") >= self.since, F.lit(False)))
        if self.until:
            found.append(F.coalesce(F.col("created_at") <= self.until, F.lit(False)))
        if self.sessions:
            found.append(F.col("session_id").isin(*self.sessions))
        return found

    def column(self) -> Column | None:
        return reduce(lambda a, b: a & b, self.parts()) if self.parts() else None

    def negated(self) -> Column | None:
        """True where no part holds: any one of an ignore rule's parts excludes a session."""
        return ~reduce(lambda a, b: a | b, self.parts()) if self.parts() else None


def merge(a: Scope, b: Scope) -> Scope:
    """``a`` with ``b`` added: lists united in order, single values replaced where ``b`` has one."""
    changes = {}
    for f in fields(Scope):
        x, y = getattr(a, f.name), getattr(b, f.name)
        changes[f.name] = tuple(dict.fromkeys([*x, *y])) if isinstance(x, tuple) else y or x
    return replace(a, **changes)


def recent(now: str, days: int = 30) -> Scope:
    from datetime import datetime, timedelta

    start = datetime.fromisoformat(now.replace("Z", "+00:00")) - timedelta(days=days)
    return Scope(since=start.strftime("%Y-%m-%dT%H:%M:%S"))


def assemble(base: Scope | None = None, call: Scope | None = None, auto: Scope | None = None, ignore: Scope | None = None, full: bool = False) -> Column:
    """base AND call AND auto AND NOT ignore. ``full`` drops all but the ignore rule."""
    wanted = [] if full else [s.column() for s in (base, call, auto) if s]
    wanted += [ignore.negated()] if ignore else []
    return reduce(lambda a, b: a & b, [c for c in wanted if c is not None], F.lit(True))
