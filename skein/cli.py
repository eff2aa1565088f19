"""Command line: ``python -m skein.cli VERB ...``; exit code 0, 1 on errors, 2 from ``analyze --fail-on``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import skein
from skein.operators import closure, dead
from skein.plans import graph, parse, report, repository, rules
from skein.sources import files


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("skein").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skein")
    top.add_argument("--version", action="version", version=f"%(prog)s {skein.__version__}")
    verbs = top.add_subparsers(dest="verb")
    for verb, argument in (("new-sprint", "name"), ("new-handoff", "name"), ("scan", "folder"), ("parse", "file"), ("lint", "file"), ("inventory", "folder")):
        verbs.add_parser(verb).add_argument(argument)
    for verb in ("dependencies", "cross-references", "impact", "circular-dependencies", "dead-objects", "analyze", "repository-analysis"):
        p = verbs.add_parser(verb)
        if verb == "impact":
            p.add_argument("root_object")
        p.add_argument("paths", nargs="+")
        p.add_argument("-o", "--output")
        p.add_argument("-r", "--recursive", action="store_true")
        p.add_argument("--compact", action="store_true")
        if verb in ("impact", "repository-analysis"):
            p.add_argument("--html")
        if verb in ("dead-objects", "analyze", "repository-analysis"):
            p.add_argument("--entry-point", action="append", default=[])
        if verb == "analyze":
            p.add_argument("--rule", action="append", default=[])
            p.add_argument("--fail-on", choices=list(rules.SEVERITIES))
    return top


def _emit(payload: dict, args: argparse.Namespace, sort_keys: bool = False, end: str = "\n") -> None:
    text = report.dump(payload, args.compact, sort_keys)
    print(report.write(text, args.output, end) if args.output else text)


def _graph(args: argparse.Namespace):
    sources = files.read_sources(_session(), args.paths, args.recursive)
    order = sources.select("source_id", "doc_ord")
    objects = parse.parse_sources(sources).join(order, "source_id")
    return graph.build_graph(objects, F.col("doc_ord")).cached(), objects


def _file_text(path: str):
    spark = _session()
    p = Path(path)
    text = p.read_text(encoding="utf-8", errors="ignore")
    return files.memory_sources(spark, [(files.source_id_of(p), text, str(p))]), text


def _run(args: argparse.Namespace) -> int:
    verb = args.verb
    if verb == "new-sprint":
        print(f"Created {report.write(f'# {args.name}', Path('sprints') / args.name / 'README.md').parent}")
    elif verb == "new-handoff":
        print(f"Created {report.write(f'# Handoff {args.name}', Path('handoffs') / f'{args.name}.md')}")
    elif verb == "inventory":
        print(report.dump(files.inventory(args.folder)))
    elif verb == "scan":
        print(report.dump(files.scan_payload(args.folder, files.scan(_session(), args.folder))))
    elif verb == "parse":
        sources, text = _file_text(args.file)
        objects = parse.parse_sources(sources).orderBy("object_ord").drop("source_id", "object_ord")
        print(report.dump({"sql_text": text, "objects": report._rows(objects)}))
    elif verb == "lint":
        sources, _ = _file_text(args.file)
        counts = {r["rule"]: r["matches"] for r in parse.lint_counts(sources).collect()}
        print(report.dump({"file": args.file, "findings": [{"rule": n, "matches": counts[n]} for n, _ in parse.LINT_PATTERNS]}))
    elif verb == "dependencies":
        _emit(report.graph_payload(_graph(args)[0]), args)
    elif verb == "cross-references":
        _emit(report.cross_reference_payload(_graph(args)[0]), args, sort_keys=True)
    elif verb == "impact":
        g, _ = _graph(args)
        found = closure.impact(g, args.root_object)
        if args.html:
            print(report.write(report.impact_html(found, closure.impact_paths(g, args.root_object)), args.html, ""))
        else:
            _emit(report.impact_payload(found), args, sort_keys=True, end="")
    elif verb == "circular-dependencies":
        _emit(report.cycles_payload(closure.cycles(_graph(args)[0])), args)
    elif verb == "dead-objects":
        g, objects = _graph(args)
        _emit(report.dead_payload(dead.detect(g, args.entry_point), objects.filter("dynamic_sql").count()), args)
    elif verb == "analyze":
        g, objects = _graph(args)
        result = rules.Engine().run(rules.Context(g, objects, rules.normal_entry_points(args.entry_point)), args.rule)
        _emit(report.rules_payload(result), args)
        if args.fail_on and result.has_at_or_above(args.fail_on):
            return 2
    elif verb == "repository-analysis":
        sources = files.read_sources(_session(), args.paths, args.recursive)
        repo = repository.analyze(sources, args.entry_point)
        payload = report.repository_payload(repo)
        _emit(payload, args)
        if args.html:
            print(report.write(report.repository_html(repo, payload), args.html, ""), file=sys.stdout if args.output else sys.stderr)
    else:
        _parser().print_help()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _run(args)
    except (OSError, ValueError, PySparkException) as problem:
        print(problem, file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
