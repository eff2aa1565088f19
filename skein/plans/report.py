"""Versioned JSON and self-contained HTML of the results.

Reports gather rows on the driver, as files for people must; every function
takes tables that the analyses have already reduced.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from skein.functions.names import fold
from skein.operators.dead import DeadObjects
from skein.plans.graph import Graph, cross_references, named_edges
from skein.plans.repository import Repository
from skein.plans.rules import Result


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def _rows(df: DataFrame, *order) -> list[dict]:
    return [_plain(r) for r in (df.orderBy(*order) if order else df).toLocalIterator()]


def dump(payload: dict, compact: bool = False, sort_keys: bool = False) -> str:
    return json.dumps(payload, ensure_ascii=False, indent=None if compact else 2, sort_keys=sort_keys)


def write(text: str, path: str | Path, end: str = "\n") -> Path:
    """Write UTF-8 text, making the folders above it."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(text + end, encoding="utf-8")
    return out


def graph_lines(graph: Graph) -> DataFrame:
    """(part, line): nodes and edges as one JSON object a row, made by the executors; ``write.text`` stores a graph of any size."""
    nodes = graph.nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("name", "object_type")).alias("line"))
    return nodes.unionByName(named_edges(graph).select(F.lit("edge").alias("part"), F.to_json(F.struct("source", "target", "kind")).alias("line")))


def graph_payload(graph: Graph) -> dict:
    edges = _rows(named_edges(graph), "src_key", "dst_key", "kind")
    return {
        "schema_version": 1,
        "nodes": [{"name": n["name"], "object_type": n["object_type"]} for n in _rows(graph.nodes, "node_key")],
        "edges": [{k: e[k] for k in ("source", "target", "kind")} for e in edges],
    }


def cross_reference_payload(graph: Graph) -> dict:
    rows = _rows(cross_references(graph), "src_key", "dst_key", "type")
    return {"schema_version": "1.0", "cross_references": [{k: r[k] for k in ("source", "target", "type")} for r in rows]}


def impact_payload(impact: DataFrame) -> dict:
    rows = _rows(impact, "ord")
    return {"schema_version": "1.0", "root_object": rows[0]["name"], "impacted_objects": sorted(r["name"] for r in rows)}


def read_impact(payload: str) -> dict:
    """An impact result from JSON; raises ValueError where version or types are wrong."""
    data = json.loads(payload)
    if not isinstance(data, dict):
        raise ValueError("impact JSON must be an object")
    if data.get("schema_version") != "1.0":
        raise ValueError(f"unsupported impact schema: {data.get('schema_version')!r}")
    root, names = data.get("root_object"), data.get("impacted_objects")
    if not isinstance(root, str) or not root.strip():
        raise ValueError("root_object must be a string that is not blank")
    if not isinstance(names, list) or any(not isinstance(n, str) for n in names):
        raise ValueError("impacted_objects must be a list of strings")
    return {"root_object": root, "impacted_objects": list(names)}


def _cycle_rows(cycles: DataFrame) -> list[dict]:
    rows = _rows(cycles, F.transform("members", fold))
    return [{"members": r["members"], "is_self_reference": r["is_self_reference"], "edges": r["edges"]} for r in rows]


def cycles_payload(cycles: DataFrame) -> dict:
    rows = _cycle_rows(cycles)
    return {"schema_version": "1.0", "summary": {"cycle_count": len(rows), "object_count": sum(len(r["members"]) for r in rows)}, "circular_dependencies": rows}


def _dead_rows(found: DeadObjects) -> tuple[list[dict], list[dict]]:
    rows = _rows(found.findings.drop("component"), F.transform(F.col("members.name"), fold))
    return rows, _rows(found.exclusions, fold("name"))


def dead_payload(found: DeadObjects, dynamic_objects: int) -> dict:
    rows, out = _dead_rows(found)
    return {
        "schema_version": "1.0",
        "classification": "candidate_only",
        "summary": {
            "defined_object_count": found.defined,
            "candidate_finding_count": len(rows),
            "candidate_object_count": sum(len(r["members"]) for r in rows),
            "excluded_object_count": len(out),
            "declared_entry_point_count": len(found.entry_points),
            "dynamic_sql_object_count": dynamic_objects,
        },
        "limitations": {"external_usage_may_exist": True, "dynamic_sql_may_hide_dependencies": dynamic_objects > 0, "safe_to_delete": False},
        "entry_points": found.entry_points,
        "dead_object_candidates": rows,
        "excluded_objects": out,
    }


def _findings(result: Result) -> list[dict]:
    place = {r.rule_id.strip().upper(): i for i, r in enumerate(result.rules)}
    rows = _rows(result.findings, F.transform("objects", fold), fold("message"))
    rows.sort(key=lambda r: place[r["rule_id"]])
    return [r | {"properties": json.loads(r["properties"])} for r in rows]


def _rules(result: Result, findings: list[dict]) -> list[dict]:
    return [
        {
            "rule_id": (rule_id := r.rule_id.strip().upper()),
            "title": r.title,
            "default_severity": r.severity,
            "finding_count": sum(f["rule_id"] == rule_id for f in findings),
            "properties": r.properties(result.context),
        }
        for r in result.rules
    ]


def rules_payload(result: Result) -> dict:
    findings = _findings(result)
    count = lambda s: sum(f["severity"] == s for f in findings)
    return {
        "schema_version": "1.0",
        "summary": {"rule_count": len(result.rules), "finding_count": len(findings), "error_count": count("error"), "warning_count": count("warning"), "info_count": count("info"), **result.context.metrics()},
        "context": {"entry_points": result.context.entry_points, "static_analysis_only": True},
        "rules": _rules(result, findings),
        "findings": findings,
    }


def repository_payload(repo: Repository) -> dict:
    """The result as twelve sections."""
    graph, findings = graph_payload(repo.graph), _findings(repo.result)
    dead_rows, out = _dead_rows(repo.context.dead)
    objects = [{k: v for k, v in r.items() if k != "object_ord"} for r in _rows(repo.object_records(), fold("name"), fold("source_id"), "object_ord")]
    dynamic = [o["name"] for o in objects if o["dynamic_sql"]]
    return {
        "schema_version": "1.0",
        "summary": _rows(repo.summary())[0],
        "sources": _rows(repo.source_inventory(), fold("source_id")),
        "objects": objects,
        "dependencies": {"nodes": graph["nodes"], "edges": graph["edges"]},
        "cycles": _cycle_rows(repo.context.cycles),
        "dead_object_candidates": [r | {"safe_to_delete": False} for r in dead_rows],
        "dead_object_exclusions": out,
        "rules": _rules(repo.result, findings),
        "findings": findings,
        "uncertainty": {"static_analysis_only": True, "dynamic_sql_object_count": len(dynamic), "dynamic_sql_objects": dynamic},
        "context": {"entry_points": repo.entry_points, "dependency_direction": "source -> target", "dead_objects_are_candidates_only": True},
    }


_STYLE = "body{font:14px sans-serif;margin:2em;color:#222}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ccc;padding:.3em .5em;text-align:left}.cards{display:flex;flex-wrap:wrap;gap:.8em}.card{border:1px solid #ccc;padding:.6em 1em}.card b{display:block;font-size:1.6em}"
_FILTER = "<script>document.getElementById('q').addEventListener('input',e=>{const q=e.target.value.toLowerCase();document.querySelectorAll('#objects tbody tr').forEach(r=>r.hidden=!r.textContent.toLowerCase().includes(q))})</script>"


def _esc(value) -> str:
    return html.escape(str(value), quote=True)


def _table(head: list[str], rows: list[list], name: str = "") -> str:
    cells = "".join("<tr>" + "".join(f"<td>{_esc(c)}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table id='{name}'><thead><tr>{''.join(f'<th>{_esc(h)}</th>' for h in head)}</tr></thead><tbody>{cells}</tbody></table>"


def _page(title: str, body: str) -> str:
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{_esc(title)}</title><style>{_STYLE}</style></head><body><h1>{_esc(title)}</h1>{body}</body></html>"


def impact_html(impact: DataFrame, paths: DataFrame | None = None, direct: list[str] | None = None) -> str:
    """Direct and indirect dependents, and the tree of paths where it is given.

    Direct ones are the given names, else those one step from the root in
    ``paths``; without either all count as indirect.
    """
    rows = _rows(impact, "ord")
    root, others = rows[0]["name"], [r["name"] for r in rows[1:]]
    listed = [r["path"] for r in _rows(paths)] if paths is not None else []
    if direct is None:
        direct = sorted({p[1] for p in listed if len(p) == 2}, key=str.casefold)
    near = {d.casefold() for d in direct}
    tree: dict = {}
    for p in listed:
        at = tree
        for name in p[1:]:
            at = at.setdefault(name, {})

    def draw(node: dict) -> str:
        items = "".join(f"<li><details open><summary>{_esc(n)}</summary>{draw(c)}</details></li>" if c else f"<li>{_esc(n)}</li>" for n, c in sorted(node.items(), key=lambda x: x[0].casefold()))
        return f"<ul>{items}</ul>" if items else ""

    panel = lambda t, names: f"<h2>{t} ({len(names)})</h2><ul>{''.join(f'<li>{_esc(n)}</li>' for n in names) or '<li>none</li>'}</ul>"
    body = f"<p>Root: <b>{_esc(root)}</b>, {len(others)} objects affected</p>"
    body += panel("Direct", [n for n in others if n.casefold() in near]) + panel("Indirect", [n for n in others if n.casefold() not in near])
    return _page(f"Impact of {root}", body + (f"<h2>Tree</h2><details open><summary>{_esc(root)}</summary>{draw(tree)}</details>" if tree else ""))


def repository_html(repo: Repository, payload: dict | None = None) -> str:
    """The repository report: metrics, findings, cycles, candidates, key objects, objects, dependencies, sources, limits."""
    p = payload or repository_payload(repo)
    shown = [k for k in p["summary"] if k not in ("dead_object_candidate_object_count", "info_count")]
    cards = "".join(f"<div class='card'><b>{p['summary'][k]}</b>{_esc(k.replace('_', ' '))}</div>" for k in shown)
    top = sorted((o for o in p["objects"] if o["dependent_count"] > 0), key=lambda o: (-o["dependent_count"], o["name"].casefold()))[:20]
    trace = sorted(p["objects"], key=lambda o: (o["source_id"].casefold(), o["name"].casefold()))
    parts = [
        f"<h2>Summary</h2><div class='cards'>{cards}</div>",
        "<h2>Findings</h2>" + _table(["Rule", "Severity", "Message"], [[f["rule_id"], f["severity"], f["message"]] for f in p["findings"]]),
        "<h2>Circular dependencies</h2>" + _table(["Members", "Edges"], [[", ".join(c["members"]), len(c["edges"])] for c in p["cycles"]]),
        "<h2>Dead-object candidates</h2><p>Candidates for review only.</p>" + _table(["Members", "Reason"], [[", ".join(m["name"] for m in c["members"]), c["reason"]] for c in p["dead_object_candidates"]]),
        "<h2>Key objects</h2>" + _table(["Name", "Type", "Dependents"], [[o["name"], o["object_type"], o["dependent_count"]] for o in top]),
        "<h2>Objects</h2><input id='q' placeholder='filter'>" + _table(["Name", "Type", "Source", "Dependencies", "Dependents"], [[o["name"], o["object_type"], o["source_id"], o["dependency_count"], o["dependent_count"]] for o in p["objects"]], "objects"),
        "<h2>Dependencies</h2>" + _table(["Source", "Kind", "Target"], [[e["source"], e["kind"], e["target"]] for e in p["dependencies"]["edges"]]),
        "<h2>Sources</h2>" + _table(["Source", "Object", "Type"], [[o["source_id"], o["name"], o["object_type"]] for o in trace]),
        f"<h2>Limits</h2><p>Static analysis only. Objects with dynamic SQL: {_esc(', '.join(p['uncertainty']['dynamic_sql_objects']) or 'none')}.</p>",
    ]
    return _page("Repository analysis", "".join(parts) + _FILTER)
