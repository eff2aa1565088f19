"""One entry to all analyses, for texts in memory as well as for tables of sources.

``given`` is a text, a list of texts, or a DataFrame (source_id, sql_text[, path]).
Texts have no identity: their fallback scripts are all called UnnamedScript and
fall together. Sources keep one script object each.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from skein.functions import tsql
from skein.operators import closure, dead
from skein.plans import graph as g
from skein.plans import parse, rules
from skein.plans import repository as repo
from skein.runtime import materialize
from skein.sources.files import memory_sources

Given = str | Iterable[str] | DataFrame


class Analyzer:
    """Parses what is given once and answers every question from that."""

    def __init__(self, spark: SparkSession, given: Given):
        if isinstance(given, DataFrame):
            self.sources = parse.canonical_sources(given)
        else:
            self.sources = memory_sources(spark, [given] if isinstance(given, str) else list(given))
        self.objects = materialize(parse.parse_sources(self.sources, source_aware=isinstance(given, DataFrame)), "objects")
        self.graph = g.build_graph(self.objects).cached()
        self._cycles: DataFrame | None = None

    def tokens(self) -> DataFrame:
        return parse.tokens(self.sources)

    def cross_references(self) -> DataFrame:
        return g.cross_references(self.graph).select("source", "target", "type")

    def outgoing(self, name: str) -> DataFrame:
        return g.outgoing(self.graph, name)

    def incoming(self, name: str) -> DataFrame:
        return g.incoming(self.graph, name)

    def dependencies_of(self, name: str) -> DataFrame:
        return g.dependencies_of(self.graph, name)

    def dependents_of(self, name: str) -> DataFrame:
        return g.dependents_of(self.graph, name)

    def impact(self, root: str) -> DataFrame:
        return closure.impact(self.graph, root)

    def impact_paths(self, root: str) -> DataFrame:
        return closure.impact_paths(self.graph, root)

    def cycles(self) -> DataFrame:
        if self._cycles is None:
            self._cycles = materialize(closure.cycles(self.graph), "cycles")
        return self._cycles

    def dead_objects(self, entry_points: Iterable[str] = ()) -> dead.DeadObjects:
        return dead.detect(self.graph, entry_points, self.cycles())

    def dynamic_object_count(self) -> int:
        return self.objects.filter("dynamic_sql").count()

    def rules(self, entry_points: Iterable[str] = (), rule_ids: Iterable[str] = (), engine: rules.Engine | None = None) -> rules.Result:
        context = rules.Context(self.graph, self.objects, rules.normal_entry_points(entry_points), _cycles=self.cycles())
        return (engine or rules.Engine()).run(context, rule_ids)


class Cursor:
    """A place in one text's tokens, for readers of their own that walk them by hand."""

    def __init__(self, text: str):
        self.tokens = tsql.tokenize(text)
        self.at = 0

    def peek(self, ahead: int = 0) -> tsql.Token | None:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else None

    def take(self, *words: str, symbol: str | None = None) -> tsql.Token | None:
        """The next token, if it is one of the words or the symbol (any token if neither is given); else None."""
        t = self.peek()
        if t is None or (words and t.word not in words) or (symbol is not None and (t.kind, t.value) != ("symbol", symbol)):
            return None
        self.at += 1
        return t

    def skip_to(self, *words: str) -> None:
        while (t := self.peek()) is not None and t.word not in words:
            self.at += 1


def repository(sources: DataFrame, entry_points: Iterable[str] = ()) -> repo.Repository:
    """The unified analysis of a table of sources."""
    return repo.analyze(sources, entry_points)
