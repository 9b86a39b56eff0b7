"""Queries over the framework half: projects that are built and run over the driver's tables.

Each writes a small project to a scratch folder and its tables to a database of its own, runs it and returns
a result that SQL over the driver's tables can confirm.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.project.engine import Config, Engine
from tessera.session import prepare, register_tables, run_sql
from tessera.sources import tables

MODELS = {
    "staging/stg_customers.sql": "/*---\nname: stg_customers\nmaterialized: table\ntests:\n  - unique: customer_id\n  - not_null: [customer_id, segment]\n---*/\nSELECT c_custkey AS customer_id, {{ text.clean('c_name') }} AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
    "staging/stg_orders.sql": "/*---\nmaterialized: view\ntests:\n  - accepted_values: {column: status, values: [O, F, P]}\n---*/\nSELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderstatus AS status FROM orders WHERE o_totalprice > 0",
    "marts/customer_summary.sql": "/*---\nowner: analytics\ntags: [marts]\n---*/\nSELECT c.customer_id, c.segment, count(o.order_id) AS n_orders, coalesce(sum(o.amount), 0) AS spent FROM stg_customers c LEFT JOIN stg_orders o ON c.customer_id = o.customer_id GROUP BY c.customer_id, c.segment",
    "marts/segments.sql": "SELECT segment, {* for s in ['O', 'F', 'P'] *}count(*) FILTER (WHERE status = '{{ s }}') AS n_{{ s.lower() }}, {* endfor *}count(*) AS n FROM stg_customers JOIN stg_orders USING (customer_id) GROUP BY segment",
    "marts/order_log.sql": "/*---\nmaterialized: incremental\nunique_key: order_id\n---*/\nSELECT order_id, status, amount FROM stg_orders\n-- #if is_incremental\nWHERE order_id % 10 = 0\n-- #endif\n",
    "marts/order_feed.sql": "/*---\nmaterialized: incremental\n---*/\nSELECT order_id, amount FROM stg_orders",
}
MACROS = {"text.star": 'def clean(column, default="unknown"):\n    """Trimmed text."""\n    return "coalesce(trim(" + column + "), \'" + default + "\')"\n'}


def project(spark: SparkSession, sf_dir: str, models: dict[str, str] = MODELS) -> Engine:
    prepare(spark)
    db = f"t_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE DATABASE {db}")
    for t in ("customer", "orders"):
        spark.sql(f"CREATE TABLE {db}.{t} USING parquet LOCATION '{os.path.abspath(os.path.realpath(sf_dir))}/{t}.parquet'" if os.path.isdir(os.path.realpath(f"{sf_dir}/{t}.parquet")) else f"CREATE VIEW {db}.{t} AS SELECT * FROM parquet.`{sf_dir}/{t}.parquet`")
    root = tempfile.mkdtemp(prefix="project-")
    for base, files in (("models", models), ("macros", MACROS)):
        for name, content in files.items():
            path = os.path.join(root, base, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(content.replace("/*---\n", f"/*---\nschema: {db}\n", 1) if base == "models" and "/*---" in content else (f"/*---\nschema: {db}\n---*/\n{content}" if base == "models" else content))
    engine = Engine(spark, Config(root, database=db))
    engine.discover()
    return engine


def ran(spark: SparkSession, sf_dir: str, select: list[str] | None = None) -> Engine:
    engine = project(spark, sf_dir)
    bad = [r for r in engine.run(select) if r.status != "success"]
    if bad:
        raise RuntimeError(f"{bad[0].model}: {bad[0].error}")
    return engine


def of(engine: Engine, model: str) -> DataFrame:
    return engine.spark.table(tables.quoted(engine.table(engine.models[model])))


def pipeline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(ran(spark, sf_dir, ["stg_customers", "stg_orders", "customer_summary"]), "marts.customer_summary").withColumn("spent", F.round("spent", 2))


def pipeline_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(ran(spark, sf_dir, ["stg_orders"]), "staging.stg_orders")


def templated_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of(ran(spark, sf_dir, ["stg_customers", "stg_orders", "segments"]), "marts.segments")


def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run changes one order in ten and must neither lose nor double a row."""
    e = ran(spark, sf_dir, ["stg_orders", "order_log"])
    m = e.models["staging.stg_orders"]
    m.sql = m.sql.replace("o_totalprice AS amount", "o_totalprice + 1 AS amount")
    e.run(["stg_orders", "order_log"])
    return of(e, "marts.order_log")


def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, appended twice."""
    e = ran(spark, sf_dir, ["stg_orders", "order_feed"])
    e.run(["order_feed"])
    return of(e, "marts.order_feed")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = project(spark, sf_dir)
    return e.state.frame(spark, "v_column_lineage_edges").filter("target_table = 'marts.customer_summary'")


def _trace(spark: SparkSession, sf_dir: str, model: str, column: str, forward: bool) -> DataFrame:
    rows = project(spark, sf_dir).state.trace(model, column, forward)
    return spark.createDataFrame([(r["model"], r["name"], r["depth"]) for r in rows], "model string, name string, depth bigint")


def trace_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir, "marts.customer_summary", "spent", False)


def trace_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir, "orders", "o_totalprice", True)


def declared_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ran(spark, sf_dir, ["stg_customers", "stg_orders"])
    rows = [(m.path, *c) for m in e.models.values() if m.tests for c in e.check(m)]
    return spark.createDataFrame(rows, "model string, test string, name string, failures bigint")


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ran(spark, sf_dir)
    return e.state.frame(spark, "v_model_runs").select("model", "status", "rows_affected", "run_status")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV seed, loaded and joined."""
    e = project(spark, sf_dir, {"named.sql": "SELECT c_custkey, label FROM customer JOIN raw_segments ON c_mktsegment = segment"})
    os.makedirs(e.folder("seeds"))
    with open(os.path.join(e.folder("seeds"), "raw_segments.csv"), "w", encoding="utf-8") as f:
        f.write("segment,label\nBUILDING,b\nMACHINERY,m\n")
    e.seed()
    e.run()
    return of(e, "named")


def asof_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join through the DataFrame operator, later matches of equal time excluded."""
    register_tables(spark, sf_dir, ["events"])
    return run_sql(spark, "SELECT a.event_id AS id, b.event_id AS before FROM (SELECT * FROM events WHERE value > 50) a ASOF JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.ts > b.ts")


_S = "(SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderstatus AS status FROM orders WHERE o_totalprice > 0)"
FRAMEWORK = {
    "pipeline_table": (pipeline_table, f"SELECT c_custkey AS customer_id, c_mktsegment AS segment, count(order_id) AS n_orders, round(coalesce(sum(amount), 0), 2) AS spent FROM customer LEFT JOIN {_S} o ON customer_id = c_custkey GROUP BY 1, 2"),
    "pipeline_view": (pipeline_view, f"SELECT * FROM {_S}"),
    "templated_model": (templated_model, f"SELECT c_mktsegment AS segment, count(*) FILTER (WHERE status = 'O') AS n_o, count(*) FILTER (WHERE status = 'F') AS n_f, count(*) FILTER (WHERE status = 'P') AS n_p, count(*) AS n FROM customer JOIN {_S} ON c_custkey = customer_id GROUP BY 1"),
    "incremental_upsert": (incremental_upsert, f"SELECT order_id, status, CASE WHEN order_id % 10 = 0 THEN amount + 1 ELSE amount END AS amount FROM {_S}"),
    "incremental_append": (incremental_append, f"SELECT order_id, amount FROM {_S}, range(2)"),
    "lineage_edges": (lineage_edges, "SELECT * FROM (VALUES ('stg_customers', 'customer_id', 'marts.customer_summary', 'customer_id'), ('stg_customers', 'segment', 'marts.customer_summary', 'segment'), ('stg_orders', 'order_id', 'marts.customer_summary', 'n_orders'), ('stg_orders', 'amount', 'marts.customer_summary', 'spent')) v(source_table, source_column, target_table, target_column)"),
    "trace_backward": (trace_backward, "SELECT * FROM (VALUES ('stg_orders', 'amount', 1), ('orders', 'o_totalprice', 2)) v(model, name, depth)"),
    "trace_forward": (trace_forward, "SELECT * FROM (VALUES ('staging.stg_orders', 'amount', 1), ('marts.customer_summary', 'spent', 2), ('marts.order_log', 'amount', 2), ('marts.order_feed', 'amount', 2)) v(model, name, depth)"),
    "declared_checks": (declared_checks, "SELECT * FROM (VALUES ('staging.stg_customers', 'unique', 'customer_id', 0), ('staging.stg_customers', 'not_null', 'customer_id', 0), ('staging.stg_customers', 'not_null', 'segment', 0), ('staging.stg_orders', 'accepted_values', 'status', 0)) v(model, test, name, failures)"),
    "run_history": (run_history, f"SELECT 'marts.customer_summary' AS model, 'success' AS status, (SELECT count(*) FROM customer) AS rows_affected, 'completed' AS run_status UNION ALL SELECT 'staging.stg_customers', 'success', (SELECT count(*) FROM customer), 'completed' UNION ALL SELECT 'staging.stg_orders', 'success', 0, 'completed' UNION ALL SELECT 'marts.segments', 'success', (SELECT count(DISTINCT c_mktsegment) FROM customer JOIN orders ON c_custkey = o_custkey), 'completed' UNION ALL SELECT 'marts.order_log', 'success', (SELECT count(*) FROM {_S}), 'completed' UNION ALL SELECT 'marts.order_feed', 'success', (SELECT count(*) FROM {_S}), 'completed'"),
    "seed_join": (seeds, "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' ELSE 'm' END AS label FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "asof_operator": (asof_operator, "SELECT a.event_id AS id, b.event_id AS before FROM (SELECT * FROM events WHERE value > 50) a ASOF JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.ts > b.ts"),
}
