"""Static-analysis rules: each turns one shared context into normalised findings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.names import fold
from skein.operators import dead
from skein.operators.closure import cycles
from skein.plans.graph import Graph
from skein.runtime import materialize

#: Severities and their ranks.
SEVERITIES = {"info": 10, "warning": 20, "error": 30}


def parse_severity(value: str) -> str:
    name = value.strip().casefold()
    if name not in SEVERITIES:
        raise ValueError(f"Unknown severity: {value}")
    return name


@dataclass
class Context:
    """What all rules share; cycles and dead objects are found once, when first asked for."""

    graph: Graph
    objects: DataFrame
    entry_points: list[str] = field(default_factory=list)
    _cycles: DataFrame | None = None
    _dead: dead.DeadObjects | None = None

    @property
    def cycles(self) -> DataFrame:
        if self._cycles is None:
            self._cycles = materialize(cycles(self.graph), "cycles")
        return self._cycles

    @property
    def dead(self) -> dead.DeadObjects:
        if self._dead is None:
            self._dead = dead.detect(self.graph, self.entry_points, self.cycles)
        return self._dead

    def metrics(self) -> dict[str, int]:
        row = self.objects.agg(F.count(F.lit(1)).alias("parsed_object_count"), F.count_if("dynamic_sql").alias("dynamic_sql_object_count")).first()
        return row.asDict() | {"graph_node_count": self.graph.nodes.count(), "dependency_edge_count": self.graph.edges.count()}


class Rule(Protocol):
    """A rule gives rows (message, objects, properties); objects an array of names, properties a struct."""

    rule_id: str
    title: str
    description: str
    severity: str

    def evaluate(self, context: Context) -> DataFrame: ...

    def properties(self, context: Context) -> dict: ...


def finding_objects(names: Column) -> Column:
    """Names trimmed, blank ones dropped, distinct in any letter case, in folded order; the first spelling stays."""
    trimmed = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    keyed = F.transform(trimmed, lambda x, i: F.struct(fold(x).alias("k"), i.alias("i"), x.alias("name")))
    ordered = F.array_sort(keyed)
    first = F.filter(ordered, lambda x, i: (i == 0) | (x["k"] != F.try_element_at(ordered, F.greatest(i, F.lit(1)))["k"]))
    return F.transform(first, lambda x: x["name"])


class CircularRule:
    rule_id, title, severity = "SQL001", "Circular dependency", "error"
    description = "Components of objects that depend on one another, and self-references."

    def evaluate(self, context: Context) -> DataFrame:
        listed = F.array_join("members", ", ")
        text = F.when(F.col("is_self_reference"), F.concat(F.lit("Self-referencing SQL object detected: "), listed)).otherwise(F.concat(F.lit("Circular dependency component detected: "), listed))
        return context.cycles.select(text.alias("message"), F.col("members").alias("objects"), F.struct(F.size("edges").alias("internal_edge_count"), "is_self_reference").alias("properties"))

    def properties(self, context: Context) -> dict:
        return {}


class DeadObjectRule:
    rule_id, title, severity = "SQL002", "Dead object candidate", "warning"
    description = "Defined components without incoming static references; each needs human review."

    def evaluate(self, context: Context) -> DataFrame:
        names = F.col("members.name")
        props = F.struct(F.lit("candidate_only").alias("classification"), F.col("external_usage_possible").alias("external_usage_may_exist"), "is_circular_component", "reason", F.lit(False).alias("safe_to_delete"))
        return context.dead.findings.select(F.concat(F.lit("Unreferenced SQL component requires review: "), F.array_join(names, ", ")).alias("message"), names.alias("objects"), props.alias("properties"))

    def properties(self, context: Context) -> dict:
        return {"defined_object_count": context.dead.defined, "excluded_object_count": context.dead.exclusions.count()}


@dataclass(frozen=True)
class Result:
    """findings (rule_id, severity, title, message, objects, properties as JSON), and the rules that ran."""

    findings: DataFrame
    rules: list[Rule]
    context: Context

    def severity_counts(self) -> DataFrame:
        return self.findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))

    def count(self, severity: str) -> int:
        return self.findings.filter(F.col("severity") == parse_severity(severity)).count()

    def has_at_or_above(self, severity: str) -> bool:
        least = SEVERITIES[parse_severity(severity)]
        return not self.findings.filter(F.col("severity").isin([s for s, r in SEVERITIES.items() if r >= least])).isEmpty()


def normal_entry_points(entry_points: Iterable[str]) -> list[str]:
    """Trimmed, distinct in any letter case with the first spelling kept, in folded order."""
    kept: dict[str, str] = {}
    for e in entry_points:
        if not e.strip():
            raise ValueError("Entry point name cannot be empty")
        kept.setdefault(e.strip().casefold(), e.strip())
    return [kept[k] for k in sorted(kept)]


class Engine:
    """Runs rules by id: requested ones in their order, else all in order of id."""

    def __init__(self, rules: Iterable[Rule] | None = None):
        chosen = [CircularRule(), DeadObjectRule()] if rules is None else list(rules)
        if not chosen:
            raise ValueError("at least one rule is needed")
        self.rules: dict[str, Rule] = {}
        for rule in chosen:
            key = self._id(rule.rule_id)
            if key in self.rules:
                raise ValueError(f"Duplicate rule id: {key}")
            self.rules[key] = rule

    @staticmethod
    def _id(rule_id: str) -> str:
        if not rule_id.strip():
            raise ValueError("a rule id cannot be empty")
        return rule_id.strip().upper()

    def run(self, context: Context, rule_ids: Iterable[str] = ()) -> Result:
        asked = list(dict.fromkeys(self._id(r) for r in rule_ids)) or sorted(self.rules)
        if unknown := [r for r in asked if r not in self.rules]:
            raise ValueError(f"Unknown rules: {', '.join(unknown)}; there are {', '.join(sorted(self.rules))}")
        out = None
        for rule_id in asked:
            rule = self.rules[rule_id]
            rows = rule.evaluate(context).select(
                F.lit(rule_id).alias("rule_id"),
                F.lit(parse_severity(rule.severity)).alias("severity"),
                F.lit(rule.title.strip()).alias("title"),
                F.trim("message").alias("message"),
                finding_objects(F.col("objects")).alias("objects"),
                F.to_json("properties").alias("properties"),
            )
            out = rows if out is None else out.unionByName(rows)
        return Result(materialize(out, "findings"), [self.rules[r] for r in asked], context)
