"""Command line: run, seed, list, dag, lineage, render, lint, doctor, format, query, test, search, history."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lint.analyzer import health_score, lint_project
from tessera.lint.rules import PROJECT_RULES, SQL_RULES
from tessera.plans.printer import format_sql
from tessera.project.engine import Config, Engine


FORMATS = ("table", "json", "csv", "md")


def write_rows(df: DataFrame, form: str, out: TextIO) -> None:
    """Writes a result as a table (Spark's first rows), JSON lines, CSV or a Markdown table, row by row as it comes."""
    if form == "table":
        df.show(truncate=False)
        return
    if form == "json":
        for row in df.toJSON().toLocalIterator():
            out.write(row + "\n")
        return
    rows = df.select(*[F.col(f"`{c}`").cast("string") if "binary" not in t else F.base64(f"`{c}`") for c, t in df.dtypes]).toLocalIterator()
    if form == "csv":
        write = csv.writer(out, lineterminator="\n").writerow
        write(df.columns)
        for r in rows:
            write(["" if x is None else x for x in r])
        return
    line = lambda xs: out.write("| " + " | ".join("" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |\n")
    line(df.columns)
    line(["---"] * len(df.columns))
    for r in rows:
        line(r)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--project", default=".", help="the folder with models, macros and seeds")
    p.add_argument("--environment", default="dev")
    p.add_argument("--database", default="default")
    p.add_argument("--state", default=":memory:")
    p.add_argument("--dialect", default="duckdb")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("--select", nargs="*")
    run.add_argument("--downstream", action="store_true")
    for name in ("seed", "list", "dag", "lint", "doctor", "rules", "test", "history", "discover"):
        sub.add_parser(name)
    for name in ("render", "lineage", "search", "query", "format"):
        sub.add_parser(name).add_argument("what")
    sub.choices["query"].add_argument("--format", choices=FORMATS, default="table")
    a = p.parse_args(args)
    show = lambda x: print(x if isinstance(x, str) else json.dumps(x, default=str))
    if a.command == "rules":
        for k, (title, severity, _) in sorted({**SQL_RULES, **PROJECT_RULES}.items()):
            show(f"{k} {severity}: {title}")
        return 0
    if a.command == "format":
        with open(a.what, encoding="utf-8") as f:
            show(format_sql(f.read(), a.dialect))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    e = Engine(spark, Config(a.project, a.environment, a.database, a.dialect, a.state))
    if a.command == "seed":
        show(e.seed())
        return 0
    e.discover()
    for w in e.warnings:
        print("warning:", w, file=sys.stderr)
    if a.command == "run":
        e.seed()
        results = e.run(a.select, a.downstream)
        for r in results:
            show(f"{r.status:8} {r.model} {r.rows} {r.error}".rstrip())
        return int(any(r.status != "success" for r in results))
    if a.command in ("list", "discover"):
        for m in e.models.values():
            show(f"{m.path} {m.materialized}")
    elif a.command == "dag":
        for k, level in enumerate(e.dag.levels()):
            show(f"{k}: {', '.join(level)}")
    elif a.command == "render":
        show(e.render(e.models[e.names()[a.what.lower()]]))
    elif a.command == "lineage":
        for c in e.models[e.names()[a.what.lower()]].columns:
            show(f"{c.name} <- {', '.join(f'{s.table}.{s.column}' for s in c.sources)} {c.transform} {c.function}".rstrip())
    elif a.command == "search":
        for r in e.state.search(a.what):
            show(r["path"])
    elif a.command == "query":
        write_rows(e.query(a.what), a.format, sys.stdout)
    elif a.command == "history":
        for r in e.state.rows("SELECT * FROM v_runs"):
            show(r)
    elif a.command == "test":
        bad = 0
        for m in e.models.values():
            for kind, column, n in e.check(m) if m.tests else ():
                bad += n > 0
                show(f"{'fail' if n else 'pass'} {m.path} {kind} {column} {n}")
        return int(bad > 0)
    else:
        issues = lint_project(e)
        for i in issues:
            show(f"{i.model}:{i.line} {i.rule} {i.severity}: {i.message}")
        if a.command == "doctor":
            show(f"health {health_score(issues, len(e.models))}")
        return int(any(i.severity == "error" for i in issues))
    return 0


if __name__ == "__main__":
    sys.exit(main())
