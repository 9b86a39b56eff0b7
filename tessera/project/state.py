"""Run state and metadata in SQLite, and as DataFrames with views over them."""

from __future__ import annotations

import json
import sqlite3
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_TABLES = {
    "runs": "id TEXT PRIMARY KEY, environment TEXT, status TEXT, started_at REAL, completed_at REAL, error TEXT",
    "models": "path TEXT PRIMARY KEY, name TEXT, materialized TEXT, unique_key TEXT, content_hash TEXT, file_path TEXT, owner TEXT, schema_name TEXT, tags TEXT, tests TEXT, meta TEXT, description TEXT, sql TEXT, uses_star INTEGER",
    "model_runs": "id TEXT PRIMARY KEY, run_id TEXT, model TEXT, status TEXT, rows_affected INTEGER, started_at REAL, completed_at REAL, error TEXT, render_ms REAL, execution_ms REAL",
    "dependencies": "model TEXT, parent TEXT",
    "external_sources": "model TEXT, source TEXT",
    "environments": "name TEXT PRIMARY KEY, commit_ref TEXT, created_at REAL",
    "model_columns": "model TEXT, name TEXT, position INTEGER, transform TEXT, function TEXT",
    "column_lineage": "model TEXT, name TEXT, source_table TEXT, source_column TEXT",
    "macros": "namespace TEXT, name TEXT, args TEXT, doc TEXT, line INTEGER",
    "file_hashes": "file TEXT PRIMARY KEY, hash TEXT",
    "column_snapshots": "run_id TEXT, model TEXT, source TEXT, name TEXT, position INTEGER, taken_at REAL",
}
_KEPT_RUNS = 5
VIEWS = {
    "v_models": "SELECT m.*, (SELECT count(*) FROM dependencies d WHERE d.model = m.path) AS n_parents, (SELECT count(*) FROM dependencies d WHERE d.parent = m.path) AS n_children FROM models m",
    "v_dependencies": "SELECT d.model, m.name AS model_name, d.parent, p.name AS parent_name FROM dependencies d JOIN models m ON m.path = d.model JOIN models p ON p.path = d.parent",
    "v_dependents": "SELECT parent AS model, model AS dependent FROM dependencies",
    "v_sources": "SELECT source, count(*) AS n_models FROM external_sources GROUP BY source",
    "v_source_refs": "SELECT source, model FROM external_sources",
    "v_lineage_edges": "SELECT parent AS source, model AS target, 'model' AS kind FROM dependencies UNION ALL SELECT source, model, 'source' FROM external_sources",
    "v_columns": "SELECT c.model, m.name AS model_name, c.name, c.position, c.transform, c.function FROM model_columns c JOIN models m ON m.path = c.model",
    "v_column_sources": "SELECT model, name, source_table, source_column FROM column_lineage",
    "v_column_lineage_edges": "SELECT source_table, source_column, model AS target_table, name AS target_column FROM column_lineage",
    "v_column_lineage_nodes": "SELECT model AS table_name, name AS column_name FROM model_columns UNION SELECT source_table, source_column FROM column_lineage",
    "v_source_columns": "SELECT DISTINCT l.source_table, l.source_column FROM column_lineage l LEFT JOIN models m ON m.path = l.source_table OR m.name = l.source_table WHERE m.path IS NULL",
    "v_macros": "SELECT namespace || '.' || name AS full_name, args, doc, line FROM macros",
    "v_runs": "SELECT r.*, (SELECT count(*) FROM model_runs x WHERE x.run_id = r.id) AS n_models, (SELECT count(*) FROM model_runs x WHERE x.run_id = r.id AND x.status = 'failed') AS n_failed, r.completed_at - r.started_at AS seconds FROM runs r",
    "v_model_runs": "SELECT x.*, r.environment, r.status AS run_status FROM model_runs x JOIN runs r ON r.id = x.run_id",
    "v_failed_runs": "SELECT x.run_id, x.model, x.error FROM model_runs x WHERE x.status = 'failed'",
    "v_stale_models": "SELECT m.path, m.name, max(x.completed_at) AS last_success FROM models m LEFT JOIN model_runs x ON x.model = m.path AND x.status = 'success' GROUP BY m.path, m.name",
}


class State:
    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path)
        self.db.row_factory = sqlite3.Row
        for name, columns in _TABLES.items():
            self.db.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
        for name, sql in VIEWS.items():
            self.db.execute(f"CREATE VIEW IF NOT EXISTS {name} AS {sql}")
        self.db.commit()

    def close(self) -> None:
        self.db.close()

    def rows(self, sql: str, *args) -> list[dict]:
        return [dict(r) for r in self.db.execute(sql, args)]

    def put(self, table: str, **values) -> None:
        self.db.execute(f"INSERT OR REPLACE INTO {table} ({', '.join(values)}) VALUES ({', '.join('?' * len(values))})", tuple(values.values()))
        self.db.commit()

    def start_run(self, environment: str) -> str:
        run = uuid.uuid4().hex
        self.put("runs", id=run, environment=environment, status="running", started_at=time.time())
        return run

    def end_run(self, run: str, error: str = "") -> None:
        self.db.execute("UPDATE runs SET status = ?, completed_at = ?, error = ? WHERE id = ?", ("failed" if error else "completed", time.time(), error, run))
        old = [r["id"] for r in self.rows("SELECT id FROM runs ORDER BY started_at DESC LIMIT -1 OFFSET ?", _KEPT_RUNS)]
        self.db.executemany("DELETE FROM column_snapshots WHERE run_id = ?", [(x,) for x in old])
        self.db.commit()

    def save_project(self, models: dict, parents: dict[str, set[str]], external: dict[str, list[str]], macros: dict[str, dict]) -> None:
        """Replaces what is known of the project; files that are gone go."""
        for t in ("models", "dependencies", "external_sources", "model_columns", "column_lineage", "macros"):
            self.db.execute(f"DELETE FROM {t}")
        for m in models.values():
            self.put("models", path=m.path, name=m.name, materialized=m.materialized, unique_key=",".join(m.unique_key), content_hash=m.content_hash, file_path=m.file, owner=m.owner, schema_name=m.schema, tags=json.dumps(m.tags), tests=json.dumps(m.tests), meta=json.dumps(m.meta), description=m.description, sql=m.sql, uses_star=int(m.uses_star))
            self.db.executemany("INSERT INTO dependencies VALUES (?, ?)", [(m.path, p) for p in sorted(parents.get(m.path, ()))])
            self.db.executemany("INSERT INTO external_sources VALUES (?, ?)", [(m.path, s) for s in external.get(m.path, [])])
            for c in m.columns:
                self.db.execute("INSERT INTO model_columns VALUES (?, ?, ?, ?, ?)", (m.path, c.name, c.index, c.transform, c.function))
                self.db.executemany("INSERT INTO column_lineage VALUES (?, ?, ?, ?)", [(m.path, c.name, s.table, s.column) for s in c.sources])
        for space, functions in macros.items():
            self.db.executemany("INSERT INTO macros VALUES (?, ?, ?, ?, ?)", [(space, n, json.dumps(f.signature), f.doc, f.line) for n, f in functions.items()])
        self.db.commit()

    def trace(self, model: str, column: str, forward: bool = False, depth: int = 20) -> list[dict]:
        """Columns that feed a column (or that it feeds), by distance."""
        step = "l.source_table, l.source_column FROM t JOIN column_lineage l ON l.name = t.c AND (l.model = t.m OR l.model IN (SELECT path FROM models WHERE name = t.m))"
        if forward:
            step = "l.model, l.name FROM t JOIN column_lineage l ON l.source_column = t.c AND (l.source_table = t.m OR l.source_table IN (SELECT name FROM models WHERE path = t.m) OR l.source_table IN (SELECT path FROM models WHERE name = t.m))"
        first, rest = step.split(" FROM t ")
        sql = f"WITH RECURSIVE t(m, c, d) AS (SELECT ?, ?, 0 UNION SELECT {first}, t.d + 1 FROM t {rest} WHERE t.d < ?) SELECT m AS model, c AS name, min(d) AS depth FROM t WHERE d > 0 GROUP BY m, c ORDER BY depth, m, c"
        return self.rows(sql, model, column, depth)

    def search(self, words: str) -> list[dict]:
        """Models whose name, path, description or SQL holds every word."""
        cond = " AND ".join("lower(name || ' ' || path || ' ' || description || ' ' || sql) LIKE ?" for _ in words.split())
        return self.rows(f"SELECT path, name FROM models WHERE {cond or '1'} ORDER BY path", *[f"%{w.lower()}%" for w in words.split()])

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """A state table or view as a DataFrame."""
        cur = self.db.execute(f"SELECT * FROM {name}")
        cols = [d[0] for d in cur.description]
        kinds = {"position": "bigint", "depth": "bigint", "line": "bigint", "rows_affected": "bigint", "uses_star": "bigint"}
        rows = [tuple(r) for r in cur]
        schema = ", ".join(f"`{c}` " + (kinds.get(c) or ("double" if c.endswith(("_at", "_ms")) or c in ("seconds", "last_success") else "bigint" if c.startswith("n_") else "string")) for c in cols)
        return spark.createDataFrame(rows, schema)
