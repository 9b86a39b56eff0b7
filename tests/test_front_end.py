"""Parser, printer, templates, graph, lineage and lint, without a session."""

import pytest

from tessera.functions.catalog import date_pattern
from tessera.functions.types import spark_type
from tessera.lineage.extract import Source, extract
from tessera.lint.analyzer import health_score, lint_sql
from tessera.plans.lexer import SqlError
from tessera.plans.parser import parse
from tessera.plans.printer import format_sql
from tessera.project.dag import Dag
from tessera.project.loader import LoadError, parse_model, yaml
from tessera.project.template import TemplateError, load_macros, render
from tessera.queries import PAIRS, SAME


@pytest.mark.parametrize("name", [*SAME, *PAIRS])
def test_printing_is_stable(name):
    text = SAME.get(name) or PAIRS[name][0]
    once = format_sql(text)
    assert parse(once) == parse(text) or format_sql(once) == once
    assert format_sql(once) == once


@pytest.mark.parametrize("sql", ["SELECT", "SELECT a FROM", "SELECT a b c FROM t", "SELECT a FROM t WHERE", "SELECT a FROM t JOIN u", "SELECT a FROM t CROSS JOIN u ON 1 = 1", "SELECT (a FROM t", "SELECT a FROM t GROUP", "SELECT 'x FROM t"])
def test_broken_statements(sql):
    with pytest.raises(SqlError):
        parse(sql)


@pytest.mark.parametrize("dialect, sql", [("postgres", "SELECT * FROM t QUALIFY x = 1"), ("ansi", "SELECT a FROM t WHERE a ILIKE 'x'"), ("postgres", "SELECT * EXCLUDE (a) FROM t"), ("databricks", "SELECT * FROM a ASOF JOIN b ON a.t >= b.t"), ("postgres", "SELECT [1, 2]"), ("ansi", "SELECT a FROM t GROUP BY ALL")])
def test_dialects_refuse(dialect, sql):
    parse(sql)
    with pytest.raises(SqlError):
        parse(sql, dialect)


def test_types():
    assert [spark_type(x) for x in ("DECIMAL", "NUMERIC(10, 2)", "HUGEINT", "TEXT", "INTEGER[]", "STRUCT(a INT, b TEXT[])", "MAP(INT, TEXT)", "INT8")] == ["DECIMAL(18,3)", "DECIMAL(10,2)", "DECIMAL(38,0)", "STRING", "ARRAY<INT>", "STRUCT<a: INT, b: ARRAY<STRING>>", "MAP<INT, STRING>", "BIGINT"]
    assert date_pattern("%d/%m/%Y at %H") == "dd/MM/yyyy 'a''t' HH"


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT id FROM users", [("id", "", "", {("users", "id")})]),
        ("SELECT u.id AS k, 1 AS one FROM users u", [("k", "", "", {("users", "id")}), ("one", "EXPR", "", set())]),
        ("SELECT upper(name) AS n, a + b AS s FROM t", [("n", "", "", {("t", "name")}), ("s", "EXPR", "", {("t", "a"), ("t", "b")})]),
        ("SELECT count(*) AS c, sum(x) FROM t", [("c", "EXPR", "count", set()), ("sum", "EXPR", "sum", {("t", "x")})]),
        ("SELECT row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM t", [("r", "EXPR", "row_number", {("t", "a"), ("t", "b")})]),
        ("WITH c AS (SELECT id AS k FROM users) SELECT k FROM c", [("k", "", "", {("users", "id")})]),
        ("SELECT x.k FROM (SELECT a + b AS k FROM t) x", [("k", "", "", {("t", "a"), ("t", "b")})]),
        ("SELECT a FROM t UNION SELECT b FROM u", [("a", "EXPR", "", {("t", "a"), ("u", "b")})]),
        ("SELECT now() AS t, CASE WHEN a > 0 THEN b END AS c FROM t", [("t", "EXPR", "now", set()), ("c", "EXPR", "", {("t", "a"), ("t", "b")})]),
        ("SELECT list_transform(l, x -> x + y) AS z FROM t", [("z", "EXPR", "", {("t", "l"), ("t", "y")})]),
        ("SELECT (SELECT max(v) FROM u) AS m FROM t", [("m", "EXPR", "", {("u", "v")})]),
        ("SELECT * FROM t", [("*", "", "", {("t", "*")})]),
    ],
)
def test_column_lineage(sql, expected):
    assert [(c.name, c.transform, c.function, {(s.table, s.column) for s in c.sources}) for c in extract(sql).columns] == expected


def test_lineage_with_schema_and_dependencies():
    x = extract("SELECT * EXCLUDE (b) RENAME (a AS z) FROM t WHERE k IN (SELECT k FROM u)", schema={"t": ["a", "b", "c"]})
    assert [(c.name, c.sources) for c in x.columns] == [("z", [Source("t", "a")]), ("c", [Source("t", "c")])]
    assert x.sources == ["t"] and x.dependencies == ["t", "u"] and x.uses_star


def test_templates():
    macros = load_macros('def twice(x, *rest, sep=", "):\n    """Doc."""\n    out = []\n    for r in [x] + list(rest):\n        if r == "skip":\n            continue\n        out.append(r * 2)\n    return sep.join(out)\ndef _hidden():\n    return 1\n')
    assert list(macros) == ["twice"] and macros["twice"].doc == "Doc." and macros["twice"].signature == ["x", "*rest"]
    assert render("{{ f('a', 'skip', 'b') }}{{ None }}{{ 3 }}", {"f": macros["twice"]}) == "aa, bb3"
    assert render("{* for a, b in [(1, 'x'), (2, 'y')]: *}{* if a == 1: *}[{{ b }}]{* elif a == 2: *}<{{ b }}>{* else: *}?{* endif *}{* endfor *}", {}) == "[x]<y>"
    assert render("{{ {'a': [1, 2]}['a'][1] }} {{ ', '.join([c.upper() for c in 'ab']) }}", {}) == "2 A, B"


@pytest.mark.parametrize("text", ["{{ x", "{* for a in b: *}", "{* endif *}", "{{ missing }}", "{{ ''.__class__ }}", "{{ __import__('os') }}", "{{ '{0.__class__}'.format(1) }}", "{* while 1: *}{* endwhile *}", "{{ open('x') }}", "{{ 'x' * 10000000 }}"])
def test_templates_refuse(text):
    with pytest.raises(TemplateError):
        render(text, {"b": []})


def test_model_files():
    m = parse_model("/*---\nname: n\nmaterialized: incremental\nunique_key: id\ntags: [a, b]\ntests:\n  - unique: id\n  - accepted_values:\n      column: s\n      values: [x, y]\nmeta:\n  k: 1\n---*/\n-- @import(other)\nSELECT 1 AS id;\n-- #if is_incremental\nWHERE x > 1\n-- #endif\n", "marts.m")
    assert (m.name, m.materialized, m.unique_key, m.tags, m.meta, m.imports) == ("n", "incremental", ["id"], ["a", "b"], {"k": 1}, ["other"])
    assert m.tests == [{"unique": "id"}, {"accepted_values": {"column": "s", "values": ["x", "y"]}}] and m.conditionals == [("is_incremental", "WHERE x > 1")]
    assert m.sql == "SELECT 1 AS id"
    assert yaml("a:\n  - b: 1\n    c: [x]\n  - d") == {"a": [{"b": 1, "c": ["x"]}, "d"]}
    for bad in ("/*---\nnope: 1\n---*/\nSELECT 1", "/*---\nmaterialized: cube\n---*/\nSELECT 1", "/*---\nname: x\nSELECT 1"):
        with pytest.raises(LoadError):
            parse_model(bad, "m")


def test_graph():
    d = Dag()
    for a, b in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "x")):
        d.edge(a, b)
    assert d.levels() == [["a", "x"], ["b", "c"], ["d"]] and d.cycle() is None
    assert d.affected(["b"]) == {"b", "d"} and d.upstream(["d"]) == {"a", "b", "c", "d"} and d.roots() == ["a", "x"] and d.leaves() == ["d", "x"]
    assert d.subgraph(["a", "d", "c"]).order() == ["a", "c", "d"]
    d.edge("d", "a")
    assert set(d.cycle()) <= {"a", "b", "c", "d"}
    with pytest.raises(ValueError, match="circular dependency"):
        d.order()


@pytest.mark.parametrize("rule, bad, good", [
    ("AM01", "SELECT DISTINCT a FROM t GROUP BY a", "SELECT DISTINCT a FROM t"), ("AM02", "SELECT a FROM t UNION SELECT a FROM u", "SELECT a FROM t UNION ALL SELECT a FROM u"), ("AM05", "SELECT 1 AS x FROM a, b", "SELECT 1 AS x FROM a, b WHERE a.i = b.i"),
    ("AM07", "SELECT a FROM t UNION SELECT a, b FROM u", "SELECT a FROM t UNION SELECT b FROM u"), ("AM09", "SELECT a FROM t LIMIT 1", "SELECT a FROM t ORDER BY a LIMIT 1"), ("CV02", "SELECT ifnull(a, 1) AS a FROM t", "SELECT coalesce(a, 1) AS a FROM t"), ("CV04", "SELECT count(1) AS n FROM t", "SELECT count(*) AS n FROM t"),
    ("CV05", "SELECT a FROM t WHERE a = NULL", "SELECT a FROM t WHERE a IS NULL"), ("CV08", "SELECT a.x FROM a RIGHT JOIN b ON a.i = b.i", "SELECT a.x FROM a LEFT JOIN b ON a.i = b.i"), ("AL03", "SELECT a + 1, b FROM t", "SELECT a + 1 AS c, b FROM t"), ("AL04", "SELECT 1 AS x FROM a t JOIN b t ON 1 = 2", "SELECT 1 AS x FROM a JOIN b ON a.i = b.i"),
    ("AL05", "SELECT a.x FROM a JOIN bb b ON a.i = 1", "SELECT a.x FROM a JOIN bb b ON a.i = b.i"), ("AL08", "SELECT a, b AS a FROM t", "SELECT a, b FROM t"), ("ST01", "SELECT CASE WHEN a THEN 1 ELSE NULL END AS x FROM t", "SELECT CASE WHEN a THEN 1 END AS x FROM t"), ("ST03", "WITH c AS (SELECT 1 AS x) SELECT a FROM t", "WITH c AS (SELECT 1 AS x) SELECT x FROM c"),
    ("ST10", "SELECT a FROM t WHERE 1 = 1", "SELECT a FROM t WHERE a = 1"), ("ST11", "SELECT a.x FROM a LEFT JOIN b ON a.i = b.i", "SELECT a.x, b.y FROM a LEFT JOIN b ON a.i = b.i"), ("RF01", "SELECT z.a FROM t", "SELECT t.a FROM t"), ("RF03", "SELECT t.a, b FROM t", "SELECT a, b FROM t"), ("CV01", "SELECT a FROM t WHERE a <> 1 AND b != 2", "SELECT a FROM t WHERE a <> 1"),
])
def test_sql_rules(rule, bad, good):
    assert rule in [i.rule for i in lint_sql(bad)]
    assert rule not in [i.rule for i in lint_sql(good)]
    assert rule not in [i.rule for i in lint_sql(bad, disabled=frozenset([rule]))]


def test_health():
    assert health_score([], 3) == 100 and health_score(lint_sql("SELECT a FROM t WHERE a = NULL"), 3) == 90
    assert lint_sql("SELECT FROM")[0].rule == "PARSE"


def test_metadata_functions_and_refusals(spark, tmp_path):
    from tessera.plans.lexer import SqlError
    from tessera.session import run_sql

    (tmp_path / "a.csv").write_text("x\n1\n")
    assert [r.file.rsplit("/", 1)[-1] for r in run_sql(spark, f"SELECT file FROM glob('{tmp_path}/*.csv')").collect()] == ["a.csv"]
    spark.range(3).createOrReplaceTempView("some_view")
    assert ("some_view",) in {tuple(r) for r in run_sql(spark, "SELECT view_name FROM duckdb_views()").collect()}
    assert "default" in {r[0] for r in run_sql(spark, "SELECT schema_name FROM duckdb_schemas()").collect()}
    assert run_sql(spark, "SELECT * FROM duckdb_settings() WHERE name = 'spark.sql.shuffle.partitions'").count() == 1
    assert run_sql(spark, "SELECT * FROM duckdb_functions() WHERE function_name = 'abs'").count() == 1
    assert run_sql(spark, "SELECT column_name, data_type FROM duckdb_columns() WHERE table_name = 'some_view'").collect() == [("id", "bigint")]
    with pytest.raises(SqlError, match="no counterpart"):
        run_sql(spark, "SELECT * FROM duckdb_secrets()")


def test_result_formats(spark):
    import io

    from tessera.cli import write_rows

    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    got = {}
    for form in ("json", "csv", "md"):
        out = io.StringIO()
        write_rows(df, form, out)
        got[form] = out.getvalue()
    assert got == {"json": '{"k":1,"v":"a|b"}\n{"k":2}\n', "csv": "k,v\n1,a|b\n2,\n", "md": "| k | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"}


def test_range_joins_by_bins(spark):
    from tessera.session import run_sql

    spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 5.0), (3, 9.0, 2.0), (4, None, 3.0), (5, -3.5, 1000.0)], "id int, lo double, hi double").createOrReplaceTempView("spans")
    spark.createDataFrame([(k, float(k)) for k in range(-5, 15)] + [(99, None), (100, 1e6)], "p int, x double").createOrReplaceTempView("points")
    for on in ("x BETWEEN lo AND hi", "p.x >= s.lo AND p.x < s.hi", "p.x > s.lo AND p.x <= s.hi"):
        text = f"SELECT s.id, p.p, * FROM spans s JOIN points p ON {on}"
        df = run_sql(spark, text)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "_bin0" not in df.columns and "_bin1" not in df.columns
        want = spark.sql(text)
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_swaps_survive_failures(spark):
    from tessera.sources import tables

    spark.sql("CREATE DATABASE IF NOT EXISTS swaps")
    tables.write_table(spark, spark.range(3), "swaps.t")
    tables.write_table(spark, spark.range(5), "swaps.t")
    assert spark.table("swaps.t").count() == 5 and not spark.catalog.tableExists("swaps.t__old")
    spark.sql("ALTER TABLE swaps.t RENAME TO swaps.t__old")  # as if the run had died between the renames
    assert tables.exists(spark, "swaps.t") and spark.table("swaps.t").count() == 5
    batch = spark.table("swaps.t").selectExpr("id + 3 AS id")
    assert tables.upsert(spark, batch, "swaps.t", ["id"]) == 5 and spark.table("swaps.t").count() == 8
    with pytest.raises(Exception):
        tables.write_table(spark, spark.range(3).selectExpr("raise_error('no') AS x"), "swaps.t")
    assert spark.table("swaps.t").count() == 8
