"""Reading T-SQL: tokens, statements, and the evidence each object owns.

Works on one text at a time; skein.plans.parse applies it to a corpus without a
shuffle. The grammar is deliberately loose: it collects evidence and never
rejects a text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

# Lexemes in order of preference. White space and comments give no token; of a
# block comment that never ends, the last character remains.
_LEXEME = re.compile(
    r"(?P<skip>\s+|--[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*(?=[\s\S]\Z)|/\*\Z)"
    r"|(?P<symbol>[(),;])"
    r"|(?P<literal>'[^']*(?:''[^']*)*'?|\"[^\"]*(?:\"\"[^\"]*)*\"?)"
    r"|(?P<sigil>[#@](?:[^\W_]|[._$])*)"
    r"|(?P<identifier>(?:\[[^\]]*(?:\]\][^\]]*)*\]?|[\w$]+)(?:\.(?:\[[^\]]*(?:\]\][^\]]*)*\]?|[\w$]+))*)"
    r"|(?P<operator>[\s\S])"
)

# Keywords and the kinds of objects they define.
OBJECT_TYPES = {"PROCEDURE": "Stored Procedure", "VIEW": "View", "FUNCTION": "Function", "TRIGGER": "Trigger", "TABLE": "Table"}
MODULES = {"Stored Procedure", "View", "Function", "Trigger"}
NOT_OBJECTS = {"INDEX", "SCHEMA", "TYPE", "SYNONYM", "SEQUENCE", "DATABASE"}
PARAMETERS_END = {"AS", "RETURNS", "WITH", "BEGIN"}
RELATION_WORDS = {"FROM", "JOIN", "USING", "INTO", "APPLY"}
ROWSET_FUNCTIONS = {"openjson", "openquery", "openrowset"}
NO_ALIAS = {
    "APPLY", "CROSS", "EXCEPT", "FULL", "GROUP", "HAVING", "INNER", "INTERSECT", "JOIN", "LEFT", "ON", "ORDER",
    "OUTER", "PIVOT", "RIGHT", "SET", "UNION", "UNPIVOT", "USING", "WHERE", "WHEN", "WITH",
}


class Token(NamedTuple):
    kind: str
    value: str
    position: int
    word: str  # an identifier in upper case, else empty


def tokenize(text: str) -> list[Token]:
    """Tokens of kinds symbol, literal, identifier and operator, with code-point offsets."""
    out = []
    for m in _LEXEME.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        value = m.group()
        if kind == "identifier" or kind == "sigil":
            out.append(Token("identifier", value, m.start(), value.upper()))
        else:
            out.append(Token(kind, value, m.start(), ""))
    return out


_PART = re.compile(r"((?:\[[^\]]*(?:\]\][^\]]*)*\]?|[^.\[])*)(?:\.|\Z)")


def name_parts(value: str) -> list[str]:
    """The parts of a qualified name: split outside brackets, unquoted, blank ones dropped."""
    if "[" not in value:
        return [p for p in map(str.strip, value.split(".")) if p]
    raw = (m.group(1).strip() for m in _PART.finditer(value))
    return [p[1:-1].replace("]]", "]") if len(p) > 1 and p[0] == "[" and p[-1] == "]" else p for p in raw if p]


def qualified(value: str) -> tuple[str | None, str | None, str | None]:
    """(name, schema, database); parts further left are dropped."""
    last = [None, None, None, *name_parts(value)][:-4:-1]
    return last[0], last[1], last[2]


def last_part(value: str) -> str:
    return (name_parts(value) or [value.strip()])[-1].casefold()


def batches_and_statements(text: str, tokens: list[Token]) -> list[list[list[Token]]]:
    """Tokens by batch and statement; GO alone on its line ends a batch, ``;`` a statement."""
    batches: list[list[list[Token]]] = [[[]]]
    for t in tokens:
        if t.word == "GO" and _alone(text, t.position):
            batches.append([[]])
        elif t.value == ";":
            batches[-1].append([])
        else:
            batches[-1][-1].append(t)
    return [[s for s in b if s] for b in batches]


def _alone(text: str, at: int) -> bool:
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1 : len(text) if end < 0 else end].strip().upper() == "GO"


class Statement:
    """One statement's tokens with what all extractors look up."""

    def __init__(self, tokens: list[Token]):
        self.tokens = tokens
        self.words = [t.word for t in tokens]
        self.has = set(self.words)

    @cached_property
    def after_close(self) -> list[int]:
        """For each opening parenthesis the index behind the one that closes it."""
        out = [len(self.tokens)] * len(self.tokens)
        opened: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.value == "(":
                opened.append(i)
            elif t.value == ")" and opened:
                out[opened.pop()] = i + 1
        return out

    def value(self, i: int) -> str:
        return self.tokens[i].value if i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind == "identifier"

    def past_group(self, i: int) -> int:
        """Behind the parentheses that open at i, or i itself."""
        return self.after_close[i] if self.value(i) == "(" else i

    # -- definitions
    def definition(self) -> tuple[str, int, int | None] | None:
        """(object type, index of CREATE, index of the name) of what the statement defines."""
        if "CREATE" not in self.has:
            return None
        create = self.words.index("CREATE")
        for i in range(create + 1, len(self.words)):
            if self.words[i] in NOT_OBJECTS:
                return None
            if self.words[i] in OBJECT_TYPES:
                named = (j for j in range(i + 1, len(self.tokens)) if self.is_name(j) and self.value(j)[0] != "@")
                return OBJECT_TYPES[self.words[i]], create, next(named, None)
        return None

    def parameters(self, start: int) -> list[dict]:
        """Parameters of a module's header, from the token behind its name."""
        wrapped = self.value(start) == "("
        out: list[dict] = []
        current: dict | None = None
        depth, default_next = 0, False
        for i in range(start + wrapped, len(self.tokens)):
            t, word = self.tokens[i], self.words[i]
            ends = (wrapped and t.value == ")") or word in PARAMETERS_END
            if current is None:
                if ends:
                    break
                if word and t.value[0] == "@":
                    current, depth = {"name": t.value, "datatype": None, "default_value": None, "output": False}, 0
                    out.append(current)
            elif default_next:
                current["default_value"], default_next = t.value, False
            elif t.value == "(":
                depth += 1
            elif t.value == ")" and depth:
                depth -= 1
            elif t.value == ")" and not wrapped:
                continue
            elif depth == 0 and ends:
                break
            elif depth == 0 and t.value == ",":
                current = None
            elif depth == 0 and word in ("OUTPUT", "OUT"):
                current["output"] = True
            elif depth == 0 and t.value == "=":
                default_next = True
            elif word and current["datatype"] is None:
                current["datatype"] = t.value
        return out

    # -- evidence
    def variables(self) -> list[str]:
        if self.has.isdisjoint(("DECLARE", "SET")):
            return []
        pairs = zip(self.words, self.tokens[1:], strict=False)
        return [t.value for w, t in pairs if w in ("DECLARE", "SET") and t.kind == "identifier" and t.value[0] == "@"]

    def call(self) -> tuple[str | None, bool] | None:
        """(target, dynamic) of the first EXEC, EXECUTE or SP_EXECUTESQL; target None if it is not static."""
        if self.has.isdisjoint(("EXEC", "EXECUTE", "SP_EXECUTESQL")):
            return None
        for i, word in enumerate(self.words):
            if word == "SP_EXECUTESQL":
                return "sp_executesql", True
            if word in ("EXEC", "EXECUTE"):
                for t in self.tokens[i + 1 :]:
                    if t.kind == "identifier" and t.value[0] != "@":
                        return t.value, [p.casefold() for p in name_parts(t.value)[-1:]] == ["sp_executesql"]
                    if t.value == "(":
                        break
                return None, True
        return None

    def cte_names(self) -> set[str]:
        names: set[str] = set()
        for i, word in enumerate(self.words) if "WITH" in self.has else ():
            at = i + 1
            while word == "WITH" and self.is_name(at):
                body = self.past_group(at + 1)
                if not (body < len(self.words) and self.words[body] == "AS" and self.value(body + 1) == "("):
                    break
                names.add(last_part(self.value(at)))
                behind = self.after_close[body + 1]
                if self.value(behind) != ",":
                    break
                at = behind + 1
        return names

    def _alias(self, i: int) -> str | None:
        i = self.past_group(i)
        if i < len(self.words) and self.words[i] == "AS":
            i += 1
        if not self.is_name(i) or self.words[i] in NO_ALIAS or self.value(i)[0] in "@#":
            return None
        return last_part(self.value(i))

    def relations(self) -> list[tuple[str, str | None, str | None]]:
        """(name, schema, database) of the relations read or written, in order of evidence."""
        if self.has.isdisjoint(RELATION_WORDS | {"MERGE", "REFERENCES", "UPDATE"}):
            return []
        ctes = self.cte_names()

        def transient(value: str) -> bool:
            return value[0] in "#@" or last_part(value) in ctes or last_part(value) in ROWSET_FUNCTIONS

        def relation(value: str):
            name, schema, database = qualified(value)
            if transient(value) or name is None or name[:1] in ("#", "@"):
                return None
            return name, schema, database

        found, aliases, passing = [], {}, set()
        foreign = False
        for i, word in enumerate(self.words):
            at = i + 1
            if word in RELATION_WORDS:
                if not self.is_name(at):
                    continue
                r, alias = relation(self.value(at)), self._alias(at + 1)
                if r is not None:
                    found.append(r)
                    if alias is not None:
                        aliases[alias] = r
                elif alias is not None and transient(self.value(at)):
                    passing.add(alias)
            elif word == "MERGE":
                while at < len(self.words) and self.words[at] == "INTO":
                    at += 1
                if self.is_name(at) and (r := relation(self.value(at))):
                    found.append(r)
            elif word == "KEY" and i and self.words[i - 1] == "FOREIGN":
                foreign = True
            elif word == "REFERENCES" and foreign and self.is_name(at) and (r := relation(self.value(at))):
                found.append(r)
        # An updated alias may be declared behind the UPDATE.
        for i, word in enumerate(self.words):
            if word != "UPDATE" or not self.is_name(i + 1) or self.words[i + 1] == "SET":
                continue
            target = last_part(self.value(i + 1))
            r = aliases.get(target) or (None if target in passing else relation(self.value(i + 1)))
            if r is not None:
                found.append(r)
        return found


@dataclass
class Scope:
    """What one object, or the script around objects, owns."""

    name: str = "UnnamedScript"
    schema: str | None = None
    object_type: str = "Script"
    parameters: list[dict] = field(default_factory=list)
    variables: dict[str, str] = field(default_factory=dict)
    references: dict[tuple, dict] = field(default_factory=dict)
    temporary: dict[str, None] = field(default_factory=dict)
    dynamic_sql: bool = False

    @property
    def is_script(self) -> bool:
        return self.object_type == "Script" and self.name == "UnnamedScript"

    def refer(self, name: str, schema: str | None, database: str | None, kind: str) -> None:
        key = tuple((x or "").strip().casefold() for x in (database, schema, name, kind))
        self.references.setdefault(key, {"name": name, "schema": schema, "database": database, "kind": kind})

    def hold(self, temporary: str) -> None:
        self.temporary.setdefault(temporary)
        if temporary[0] == "#":
            self.temporary.setdefault("#")

    def row(self) -> dict:
        return {
            "name": self.name,
            "schema": self.schema,
            "object_type": self.object_type,
            "parameters": self.parameters,
            "variables": [{"name": v, "value": None} for v in self.variables.values()],
            "references": list(self.references.values()),
            "temporary_tables": list(self.temporary),
            "dynamic_sql": self.dynamic_sql,
        }


class _Scopes:
    """The scopes of one text; evidence without an owner opens a script."""

    def __init__(self) -> None:
        self.all: list[Scope] = []
        self.open: Scope | None = None

    def start(self, scope: Scope) -> None:
        self.open = scope
        self.all.append(scope)

    @property
    def owner(self) -> Scope:
        if self.open is None:
            self.start(Scope())
        return self.open

    def collect(self, s: Statement) -> None:
        if (d := s.definition()) is not None:
            self._define(s, *d)
        for v in s.variables():
            key = v.casefold()
            taken = self.open is not None and (key in self.open.variables or any(p["name"].casefold() == key for p in self.open.parameters))
            if not taken:
                self.owner.variables[key] = v
        if (c := s.call()) is not None:
            target, dynamic = c
            if dynamic:
                self.owner.dynamic_sql = True
            name, schema, database = qualified(target) if target is not None else (None, None, None)
            if name is not None and name.strip():
                self.owner.refer(name, schema, database, "call")
        for name, schema, database in s.relations():
            self.owner  # noqa: B018  a relation opens a script even if its name is blank
            if name.strip():
                self.owner.refer(name, schema, database, "reference")
        for word, t in zip(s.words, s.tokens, strict=True):
            if word and word[0] == "#":
                self.owner.hold(t.value)

    def _define(self, s: Statement, object_type: str, create: int, named: int | None) -> None:
        name, schema, _ = qualified(s.value(named)) if named is not None else (None, None, None)
        if object_type == "Table":
            if name is not None and name.startswith("#"):
                self.owner.hold(name)
                return
            if create == 0 and self.open is not None and self.open.object_type in MODULES:
                return
        self.start(Scope(name or f"Unnamed{object_type}", schema, object_type))
        if object_type in ("Stored Procedure", "Function") and named is not None:
            self.open.parameters = s.parameters(named + 1)


def parse(text: str | None, source_id: str | None = None) -> list[dict]:
    """The objects of one text in order; blank or null text has none.

    With a source_id all fallback scripts of the text become one object
    ``script:<source_id>`` at the place of the first.
    """
    if not text or not text.strip():
        return []
    scopes = _Scopes()
    for batch in batches_and_statements(text, tokenize(text)):
        for tokens in batch:
            scopes.collect(Statement(tokens))
        scopes.open = None
    found = scopes.all
    if source_id is not None and any(s.is_script for s in found):
        merged = Scope(f"script:{source_id}")
        temporary: dict[str, str] = {}
        for s in (s for s in found if s.is_script):
            for key, spelling in s.variables.items():
                merged.variables.setdefault(key, spelling)  # the spelling met first wins
            for r in s.references.values():
                merged.refer(r["name"], r["schema"], r["database"], r["kind"])
            for t in s.temporary:
                temporary.setdefault(t.casefold(), t)
            merged.dynamic_sql |= s.dynamic_sql
        merged.temporary = dict.fromkeys(temporary.values())
        first = next(i for i, s in enumerate(found) if s.is_script)
        found = [merged if i == first else s for i, s in enumerate(found) if i == first or not s.is_script]
    return [s.row() for s in found]
