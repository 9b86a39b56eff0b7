"""A project of SQL models on Spark: discover, order, render, materialise and record."""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage.extract import dependencies, extract
from tessera.plans.lexer import SqlError
from tessera.plans.parser import parse
from tessera.project.dag import CycleError, Dag
from tessera.project.loader import Model, load_models
from tessera.project.state import State
from tessera.project.template import Namespace, TemplateError, load_macros, render
from tessera.session import prepare, translate
from tessera.sources import tables

_GLOBALS = ("config", "env", "target", "this")


@dataclass
class Config:
    root: str
    environment: str = "dev"
    database: str = "default"
    dialect: str = "duckdb"
    state: str = ":memory:"
    variables: dict = field(default_factory=dict)
    workers: int = 1  # models of one level that run at once


@dataclass
class Result:
    model: str
    status: str
    rows: int = 0
    error: str = ""


class Engine:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = prepare(spark), config
        self.state = State(config.state)
        self.models: dict[str, Model] = {}
        self.macros: dict[str, dict] = {}
        self.dag = Dag()
        self.external: dict[str, list[str]] = {}
        self.warnings: list[str] = []

    def folder(self, name: str) -> str:
        return os.path.join(self.config.root, name)

    # -- discovery
    def discover(self) -> dict[str, Model]:
        self.macros = {}
        base = self.folder("macros")
        for f in sorted(os.listdir(base)) if os.path.isdir(base) else []:
            if f.endswith((".star", ".py")):
                space = f.rsplit(".", 1)[0]
                if space in _GLOBALS:
                    raise TemplateError(f"the macro file {f} hides the global {space}")
                with open(os.path.join(base, f), encoding="utf-8") as h:
                    self.macros[space] = load_macros(h.read())
        self.models = load_models(self.folder("models"), self.models)
        by_name = self.names()
        self.dag, self.external = Dag(), {}
        for m in self.models.values():
            self.dag.add(m.path)
            m.error = ""
            try:
                tree = parse(self.render(m), self.config.dialect)
                line = extract(tree, self.config.dialect)
                m.sources, m.columns, m.uses_star = dependencies(tree), line.columns, line.uses_star
            except (SqlError, TemplateError) as e:
                m.sources, m.columns, m.error = [], [], str(e)
            outside = []
            for s in dict.fromkeys([*m.sources, *m.imports]):
                parent = by_name.get(s.lower()) or by_name.get(s.lower().rsplit(".", 1)[-1])
                if parent is None:
                    outside.append(s)
                elif parent != m.path:
                    self.dag.edge(parent, m.path)
            self.external[m.path] = outside
        if cycle := self.dag.cycle():
            raise CycleError("circular dependency: " + " -> ".join(cycle))
        seeds = {f[:-4].lower() for f in (os.listdir(self.folder("seeds")) if os.path.isdir(self.folder("seeds")) else []) if f.lower().endswith(".csv")}
        self.warnings = [f"{m}: the source {s} is no model, seed or table" for m, names in self.external.items() for s in names if s.rsplit(".", 1)[-1].lower() not in seeds and not self.spark.catalog.tableExists(s)]
        self.state.save_project(self.models, self.dag.parents, self.external, self.macros)
        return self.models

    def names(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for m in self.models.values():
            out.setdefault(m.name.lower(), m.path)
        for m in self.models.values():
            out[m.path.lower()] = m.path
            out[self.table(m).lower()] = m.path
        return out

    def table(self, m: Model) -> str:
        head = m.path.rsplit(".", 1)[0] if "." in m.path else ""
        return f"{m.schema or head.replace('.', '_') or self.config.database}.{m.name.rsplit('.', 1)[-1]}"

    # -- rendering
    def scope(self, m: Model) -> dict:
        schema, name = self.table(m).split(".")
        out = {k: Namespace(k, v) for k, v in self.macros.items()}
        out["config"] = {"name": m.name, "materialized": m.materialized, "unique_key": m.unique_key[0] if len(m.unique_key) == 1 else m.unique_key, "owner": m.owner, "schema": m.schema, "tags": m.tags, "meta": m.meta} | self.config.variables
        out["env"] = self.config.environment
        out["target"] = Namespace("target", {"type": "spark", "schema": self.config.database, "database": self.config.database})
        out["this"] = Namespace("this", {"name": name, "schema": schema})
        return out

    def render(self, m: Model, incremental: bool = False) -> str:
        sql = m.sql
        if incremental:
            for cond, block in m.conditionals:
                if "is_incremental" in cond:
                    sql += "\n" + re.sub(r"\{\{\s*this\s*\}\}", self.table(m), block)
                    break
        return render(sql, self.scope(m)).strip().rstrip(";")

    def spark_sql(self, m: Model, sql: str) -> str:
        """Spark SQL with model names replaced by their tables."""
        return translate(self.qualified(sql), self.spark, self.config.dialect)

    def qualified(self, sql: str) -> str:
        by_name = self.names()
        tree = parse(sql, self.config.dialect)
        swaps = {}
        for t in dependencies(tree):
            path = by_name.get(t.lower()) or (by_name.get(t.lower().rsplit(".", 1)[-1]) if "." in t else None)
            if path:
                swaps[t] = self.table(self.models[path])
            elif "." not in t and (self.config.database != "default" and self.spark.catalog.tableExists(f"{self.config.database}.{t}") or not self.spark.catalog.tableExists(t)):
                swaps[t] = f"{self.config.database}.{t}"
        for old, new in swaps.items():
            if old.lower() != new.lower():
                sql = re.sub(rf"(?i)(\b(?:FROM|JOIN)\s+|,\s*){re.escape(old)}(?![\w.(])(?:(\s+(?:AS\s+)?)(?!(?:ON|USING|WHERE|GROUP|ORDER|HAVING|LIMIT|JOIN|LEFT|RIGHT|FULL|INNER|CROSS|NATURAL|SEMI|ANTI|ASOF|POSITIONAL|UNION|INTERSECT|EXCEPT|QUALIFY|WINDOW|PIVOT|UNPIVOT|FETCH|OFFSET|TABLESAMPLE)\b)(\w+))?", lambda x: f"{x[1]}{new} {x[3] or old.rsplit('.', 1)[-1]}", sql)
        return sql

    # -- running
    def seed(self) -> dict[str, int]:
        return tables.load_seeds(self.spark, self.folder("seeds"), self.config.database)

    def run(self, select: list[str] | None = None, downstream: bool = False, fail_fast: bool = False) -> list[Result]:
        """Renders all chosen models first, then runs them in order; a failure skips what depends on it."""
        chosen = set(self.models)
        if select:
            by_name = self.names()
            missing = [s for s in select if s.lower() not in by_name]
            if missing:
                raise KeyError(f"no model {', '.join(missing)}")
            chosen = {by_name[s.lower()] for s in select}
            if downstream:
                chosen = self.dag.affected(chosen)
        run = self.state.start_run(self.config.environment)
        order = [p for p in self.dag.order() if p in chosen]
        texts, results = {}, {}
        for p in order:
            m = self.models[p]
            start = time.time()
            try:
                first = not tables.exists(self.spark, self.table(m))
                texts[p] = self.render(m, m.materialized == "incremental" and not first), (time.time() - start) * 1000
            except TemplateError as e:
                results[p] = Result(p, "failed", error=str(e))
        if results:
            for p in order:
                results.setdefault(p, Result(p, "skipped"))
        else:
            for level in self.dag.subgraph(chosen).levels():
                ready = []
                for p in level:
                    bad = [q for q in self.dag.upstream([p]) & set(results) if results[q].status == "failed"]
                    if bad or fail_fast and any(r.status == "failed" for r in results.values()):
                        results[p] = Result(p, "skipped", error=f"{bad[0]} failed" if bad else "")
                    else:
                        ready.append(p)
                if self.config.workers > 1 and len(ready) > 1:
                    from concurrent.futures import ThreadPoolExecutor

                    with ThreadPoolExecutor(self.config.workers) as pool:
                        done = list(pool.map(lambda p: self.materialize(self.models[p], texts[p][0]), ready))
                else:
                    done = [self.materialize(self.models[p], texts[p][0]) for p in ready]
                results.update(zip(ready, done))
        for p in order:
            r = results[p]
            self.state.put("model_runs", id=f"{run}/{p}", run_id=run, model=p, status=r.status, rows_affected=r.rows, started_at=time.time(), completed_at=time.time(), error=r.error, render_ms=texts.get(p, ("", 0))[1], execution_ms=getattr(r, "ms", 0.0))
            if r.status == "success" and self.models[p].uses_star:
                self.snapshot(run, self.models[p])
        failed = [r for r in results.values() if r.status == "failed"]
        self.state.end_run(run, failed[0].error if failed else "")
        return [results[p] for p in order]

    def materialize(self, m: Model, sql: str) -> Result:
        start, name = time.time(), self.table(m)
        try:
            text = self.spark_sql(m, sql)
            if m.materialized == "view":
                tables.write_view(self.spark, text, name)
                out = Result(m.path, "success", 0)
            elif m.materialized == "incremental" and tables.exists(self.spark, name):
                batch = self.spark.sql(text)
                if m.unique_key:
                    out = Result(m.path, "success", tables.upsert(self.spark, batch, name, m.unique_key))
                else:
                    tables.append(self.spark, batch, name)
                    out = Result(m.path, "success", 0)
            else:
                tables.write_table(self.spark, self.spark.sql(text), name)
                out = Result(m.path, "success", self.spark.table(tables.quoted(name)).count())
        except Exception as e:  # noqa: BLE001  whatever stops a model is its result
            out = Result(m.path, "failed", error=str(e).split("\n")[0][:500])
        out.ms = (time.time() - start) * 1000
        return out

    def snapshot(self, run: str, m: Model) -> None:
        for s in m.sources:
            try:
                columns = self.spark.table(self.table(self.models[self.names()[s.lower()]]) if s.lower() in self.names() else s).columns
            except Exception:  # noqa: BLE001  a source that can't be read has no snapshot
                continue
            for i, c in enumerate(columns):
                self.state.put("column_snapshots", run_id=run, model=m.path, source=s, name=c, position=i, taken_at=time.time())

    # -- declared tests
    def check(self, m: Model) -> list[tuple[str, str, int]]:
        """(test, column, failing rows) of the model's declared tests: unique, not_null, accepted_values."""
        df, out = self.spark.table(tables.quoted(self.table(m))), []
        for t in m.tests:
            for kind, what in t.items() if isinstance(t, dict) else [(t, m.unique_key)]:
                if kind == "accepted_values":
                    out.append((kind, what["column"], df.filter(F.col(what["column"]).isNotNull() & ~F.col(what["column"]).isin(what["values"])).count()))
                    continue
                for c in [what] if isinstance(what, str) else what or []:
                    if kind == "not_null":
                        out.append((kind, c, df.filter(F.col(c).isNull()).count()))
                    elif kind == "unique":
                        out.append((kind, c, df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1").count()))
                    else:
                        raise ValueError(f"unknown test {kind!r} in {m.path}")
        return out

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(translate(self.qualified(sql), self.spark, self.config.dialect))
