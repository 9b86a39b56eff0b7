"""SQL and project rules. A SQL rule looks at one tree, a project rule at models, their graph and lineage."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tessera.plans.nodes import Node, walk


@dataclass(frozen=True)
class Issue:
    rule: str
    severity: str  # error, warning, info, hint
    message: str
    line: int = 0
    model: str = ""


SQL_RULES: dict[str, tuple[str, str, Callable]] = {}
PROJECT_RULES: dict[str, tuple[str, str, Callable]] = {}


def sql_rule(rule: str, title: str, severity: str = "warning"):
    def keep(f):
        SQL_RULES[rule] = (title, severity, f)
        return f

    return keep


def project_rule(rule: str, title: str, severity: str = "warning"):
    def keep(f):
        PROJECT_RULES[rule] = (title, severity, f)
        return f

    return keep


def selects(tree: Node) -> Iterator[Node]:
    return (n for n in walk(tree) if n.kind == "select")


def relations(source: Node | None) -> Iterator[Node]:
    if source is None:
        return
    if source.kind == "join":
        yield from relations(source.left)
        yield from relations(source.right)
    elif source.kind == "nested":
        yield from relations(source.source)
    else:
        yield source


def joins(source: Node | None) -> Iterator[Node]:
    if source is not None and source.kind == "join":
        yield from joins(source.left)
        yield from joins(source.right)
        yield source


def own(s: Node) -> Iterator[Node]:
    """Nodes of a select without those of queries inside it."""
    return walk(s, False)


def is_literal(e: Node) -> bool:
    return e.kind == "lit" or e.kind == "paren" and is_literal(e.expr)


# -- aliasing
@sql_rule("AL03", "an expression without an alias")
def _(tree):
    for s in selects(tree):
        for i in s.items:
            if i.kind == "item" and not i.alias and i.expr.kind not in ("col", "star") and not (i.expr.kind == "call" and len(s.items) == 1):
                yield i.line, "an expression in the select list has no alias"


@sql_rule("AL04", "an alias used twice", "error")
def _(tree):
    for s in selects(tree):
        for name, n in Counter((r.alias or (r.name[-1] if r.kind == "table" else "")).lower() for r in relations(s.source)).items():
            if name and n > 1:
                yield s.line, f"the relation name {name} is used {n} times"


@sql_rule("AL05", "an unused alias")
def _(tree):
    for s in selects(tree):
        used = {n.name[-2].lower() for n in walk(s) if n.kind == "col" and len(n.name) > 1} | {i.table.lower() for i in s.items if i.kind == "star" and i.table}
        many = len(list(relations(s.source))) > 1
        for r in relations(s.source):
            if many and r.alias and r.kind == "table" and r.alias.lower() not in used:
                yield s.line, f"the alias {r.alias} isn't used"


@sql_rule("AL06", "the length of an alias", "info")
def _(tree):
    for s in selects(tree):
        for r in relations(s.source):
            if r.alias and len(r.alias) > 30:
                yield s.line, f"the alias {r.alias} is longer than 30 characters"


@sql_rule("AL07", "an alias of a single table", "info")
def _(tree):
    for s in selects(tree):
        rs = list(relations(s.source))
        if len(rs) == 1 and rs[0].kind == "table" and rs[0].alias and len(rs[0].alias) == 1:
            yield s.line, f"the only table needs no alias {rs[0].alias}"


@sql_rule("AL08", "a column name that comes twice", "error")
def _(tree):
    for s in selects(tree):
        names = Counter((i.alias or (i.expr.name[-1] if i.expr.kind == "col" else "")).lower() for i in s.items if i.kind == "item")
        for name, n in names.items():
            if name and n > 1:
                yield s.line, f"the column {name} comes {n} times"


@sql_rule("AL09", "a column aliased to its own name", "info")
def _(tree):
    for s in selects(tree):
        for i in s.items:
            if i.kind == "item" and i.alias and i.expr.kind == "col" and i.expr.name[-1] == i.alias:
                yield i.line, f"{i.alias} is aliased to itself"


# -- ambiguity
@sql_rule("AM01", "DISTINCT beside GROUP BY")
def _(tree):
    for s in selects(tree):
        if s.distinct and s.group is not None:
            yield s.line, "GROUP BY makes DISTINCT needless"


@sql_rule("AM02", "UNION without ALL or DISTINCT", "info")
def _(tree):
    for n in walk(tree):
        if n.kind == "setop" and n.op == "UNION" and not n.all:
            yield 0, "UNION removes duplicates: say UNION ALL where that isn't meant"


@sql_rule("AM03", "mixed directions in ORDER BY", "info")
def _(tree):
    for n in walk(tree):
        if n.kind == "query" and n.order and len({o.desc for o in n.order}) > 1:
            yield 0, "ORDER BY mixes ASC and DESC"


@sql_rule("AM04", "a star in the outermost select", "info")
def _(tree):
    body = tree.body if tree.kind == "query" else tree
    if body.kind == "select" and any(i.kind == "star" for i in body.items):
        yield body.line, "the result's columns depend on the source's"


@sql_rule("AM05", "an implicit cross join")
def _(tree):
    for s in selects(tree):
        if any(j.how == "COMMA" for j in joins(s.source)) and s.where is None:
            yield s.line, "a comma join without WHERE is a cross join"


@sql_rule("AM06", "ORDER BY and GROUP BY by position and by name")
def _(tree):
    for s in selects(tree):
        if s.group is not None and s.group.sets:
            kinds = {is_literal(g) for g in s.group.sets if g.kind != "grouping"}
            if len(kinds) > 1:
                yield s.line, "GROUP BY mixes positions and names"


@sql_rule("AM07", "set operations of different widths", "error")
def _(tree):
    def width(b):
        if b.kind == "query":
            return width(b.body)
        if b.kind == "setop":
            return width(b.left)
        if b.kind == "select" and all(i.kind == "item" for i in b.items):
            return len(b.items)
        return None

    for n in walk(tree):
        if n.kind == "setop" and not n.by_name:
            a, b = width(n.left), width(n.right)
            if a and b and a != b:
                yield 0, f"{n.op} of {a} and {b} columns"


@sql_rule("AM08", "a join on columns of one side")
def _(tree):
    for s in selects(tree):
        for j in joins(s.source):
            if j.on is not None:
                sides = {n.name[-2].lower() for n in walk(j.on) if n.kind == "col" and len(n.name) > 1}
                cols = [n for n in walk(j.on) if n.kind == "col"]
                if cols and all(len(c.name) > 1 for c in cols) and len(sides) == 1:
                    yield s.line, "the join's condition names one side only"


@sql_rule("AM09", "LIMIT without ORDER BY")
def _(tree):
    for n in walk(tree):
        if n.kind == "query" and (n.limit is not None or n.fetch) and not n.order:
            yield 0, "LIMIT without ORDER BY gives any rows"


# -- conventions
@sql_rule("CV01", "<> and !=", "info")
def _(tree):
    kinds = {n.op for n in walk(tree) if n.kind == "binary" and n.op in ("<>", "!=")}
    if len(kinds) > 1:
        yield 0, "both <> and != are used"


@sql_rule("CV02", "coalesce", "info")
def _(tree):
    for n in walk(tree):
        if n.kind == "call" and n.name.lower() in ("ifnull", "nvl"):
            yield n.get("line", 0), f"say coalesce, not {n.name.lower()}"


@sql_rule("CV04", "count(*)", "info")
def _(tree):
    for n in walk(tree):
        if n.kind == "call" and n.name.lower() == "count" and n.args and is_literal(n.args[0]):
            yield n.get("line", 0), "say count(*)"


@sql_rule("CV05", "= NULL", "error")
def _(tree):
    for n in walk(tree):
        if n.kind == "binary" and n.op in ("=", "<>", "!=") and any(x.kind == "lit" and x.type == "null" for x in (n.left, n.right)):
            yield 0, "a comparison with NULL is never true: say IS NULL"


@sql_rule("CV08", "RIGHT JOIN", "info")
def _(tree):
    for s in selects(tree):
        if any(j.how == "RIGHT" for j in joins(s.source)):
            yield s.line, "a LEFT JOIN reads easier than a RIGHT JOIN"


@sql_rule("CV09", "blocked words", "info")
def _(tree):
    for n in walk(tree):
        if n.kind == "table" and n.name[-1].lower() in ("tmp", "temp", "test", "foo"):
            yield n.get("line", 0), f"the table name {n.name[-1]} says nothing"


# -- references
@sql_rule("RF01", "a reference to no relation", "error")
def _(tree):
    for s in selects(tree):
        names = {(r.alias or (r.name[-1] if r.kind == "table" else r.get("name", ""))) for r in relations(s.source) if r.kind not in ("pivot", "unpivot")}
        names = {n.lower() for n in names if isinstance(n, str)}
        if not names or any(r.kind in ("pivot", "unpivot", "derived") for r in relations(s.source)) or s is not (tree.body if tree.kind == "query" else tree):
            continue
        for n in own(s):
            if n.kind == "col" and len(n.name) == 2 and n.name[0].lower() not in names and not n.get("struct"):
                yield n.get("line", 0), f"{n.name[0]} is no relation here"


@sql_rule("RF02", "unqualified columns with several relations", "info")
def _(tree):
    for s in selects(tree):
        if len(list(relations(s.source))) > 1 and any(i.kind == "item" and i.expr.kind == "col" and len(i.expr.name) == 1 for i in s.items):
            yield s.line, "columns of a join are better qualified"


@sql_rule("RF03", "qualified and unqualified columns mixed", "info")
def _(tree):
    for s in selects(tree):
        if len(list(relations(s.source))) == 1:
            kinds = {len(n.name) > 1 for n in own(s) if n.kind == "col"}
            if len(kinds) > 1:
                yield s.line, "some columns are qualified, some aren't"


# -- structure
@sql_rule("ST01", "ELSE NULL", "info")
def _(tree):
    for n in walk(tree):
        if n.kind == "case" and n.other is not None and n.other.kind == "lit" and n.other.type == "null":
            yield 0, "ELSE NULL is what CASE does anyway"


@sql_rule("ST02", "a CASE that is a boolean or coalesce", "info")
def _(tree):
    for n in walk(tree):
        if n.kind == "case" and len(n.whens) == 1 and n.other is not None and n.whens[0][1].kind == "lit" and n.other.kind == "lit" and {n.whens[0][1].value.upper(), n.other.value.upper()} == {"TRUE", "FALSE"}:
            yield 0, "the condition alone says the same"


@sql_rule("ST03", "an unused CTE")
def _(tree):
    for q in walk(tree):
        if q.kind == "query" and q.ctes:
            for k, (name, _, sub) in enumerate(q.ctes):
                later = [s for _, _, s in q.ctes[k + 1 :]] + [q.body] + ([sub] if q.recursive else [])
                if not any(n.kind == "table" and n.name[-1].lower() == name.lower() for x in later for n in walk(x)):
                    yield 0, f"the CTE {name} isn't used"


@sql_rule("ST04", "a nested CASE", "info")
def _(tree):
    for n in walk(tree):
        if n.kind == "case" and n.other is not None and n.other.kind == "case":
            yield 0, "a CASE in ELSE can be more WHENs of the outer one"


@sql_rule("ST05", "a subquery in a join", "info")
def _(tree):
    for s in selects(tree):
        if any(j.right.kind == "derived" and not j.right.lateral for j in joins(s.source)):
            yield s.line, "a CTE reads easier than a subquery in a join"


@sql_rule("ST06", "simple columns first", "hint")
def _(tree):
    for s in selects(tree):
        kinds = [i.kind == "star" or i.expr.kind == "col" for i in s.items]
        if kinds != sorted(kinds, reverse=True):
            yield s.line, "plain columns after expressions"


@sql_rule("ST07", "USING", "info")
def _(tree):
    for s in selects(tree):
        if any(j.using for j in joins(s.source)):
            yield s.line, "ON says which columns are compared"


@sql_rule("ST08", "DISTINCT with parentheses")
def _(tree):
    for s in selects(tree):
        if s.distinct and s.items and s.items[0].kind == "item" and s.items[0].expr.kind == "paren":
            yield s.line, "DISTINCT is no function"


@sql_rule("ST09", "the order of a join's condition", "hint")
def _(tree):
    for s in selects(tree):
        for j in joins(s.source):
            right = (j.right.get("alias") or (j.right.name[-1] if j.right.kind == "table" else "")) or ""
            if j.on is not None and j.on.kind == "binary" and j.on.op == "=" and j.on.left.kind == "col" and len(j.on.left.name) > 1 and j.on.left.name[-2].lower() == right.lower():
                yield s.line, "the earlier table comes second in the condition"


@sql_rule("ST10", "a constant condition")
def _(tree):
    for n in walk(tree):
        if n.kind == "binary" and n.op in ("=", "<>", "!=", "<", ">", "<=", ">=") and is_literal(n.left) and is_literal(n.right):
            yield 0, "the comparison is of constants"


@sql_rule("ST11", "an unused join")
def _(tree):
    for s in selects(tree):
        if any(i.kind == "star" for i in s.items):
            continue
        for j in joins(s.source):
            name = j.right.get("alias") or (j.right.name[-1] if j.right.kind == "table" else None)
            if j.how == "LEFT" and name and j.on is not None:
                inside = Counter(n.name[-2].lower() for n in walk(j.on) if n.kind == "col" and len(n.name) > 1)[name.lower()]
                every = [n for n in walk(s) if n.kind == "col"]
                if all(len(c.name) > 1 for c in every) and sum(c.name[-2].lower() == name.lower() for c in every) == inside:
                    yield s.line, f"nothing of {name} is used"


# -- projects
def layer(path: str) -> str:
    first = path.split(".")[0].lower()
    name = path.rsplit(".", 1)[-1].lower()
    if first in ("staging", "stg") or name.startswith("stg_"):
        return "staging"
    if first in ("intermediate", "int") or name.startswith("int_"):
        return "intermediate"
    if first in ("marts", "mart") or name.startswith(("dim_", "fct_", "fact_")):
        return "marts"
    return "other"


@project_rule("PM01", "a model without parents")
def _(e):
    for p, m in e.models.items():
        if not e.dag.parents[p] and not e.external.get(p) and not m.error:
            yield p, "reads no model and no source"


@project_rule("PM02", "a source that several staging models read")
def _(e):
    seen: dict[str, list[str]] = {}
    for p, names in e.external.items():
        for s in names:
            seen.setdefault(s, []).append(p)
    for s, ps in seen.items():
        if sum(layer(p) == "staging" for p in ps) > 1:
            yield ps[0], f"the source {s} has several staging models"


@project_rule("PM03", "a staging model on a staging model")
def _(e):
    for p in e.models:
        if layer(p) == "staging":
            for q in sorted(e.dag.parents[p]):
                if layer(q) == "staging":
                    yield p, f"reads the staging model {q}"


@project_rule("PM04", "many children", "info")
def _(e):
    for p, c in e.dag.children.items():
        if len(c) > 10:
            yield p, f"{len(c)} models read it"


@project_rule("PM05", "many joined models", "info")
def _(e):
    for p, c in e.dag.parents.items():
        if len(c) > 7:
            yield p, f"it reads {len(c)} models"


@project_rule("PM06", "a downstream model on a source")
def _(e):
    for p, names in e.external.items():
        if layer(p) in ("marts", "intermediate") and names:
            yield p, f"reads the source {names[0]} past staging"


@project_rule("PM07", "a parent read again past its child", "info")
def _(e):
    for p in e.models:
        for q in sorted(e.dag.parents[p]):
            shared = e.dag.parents[q] & e.dag.parents[p]
            if shared and e.dag.children[q] == {p}:
                yield p, f"reads {sorted(shared)[0]} and {q}, which reads it only for this"


@project_rule("PS01", "a name that doesn't fit its folder", "info")
def _(e):
    for p in e.models:
        first, name = p.split(".")[0].lower(), p.rsplit(".", 1)[-1].lower()
        if first == "staging" and not name.startswith("stg_") or first == "intermediate" and not name.startswith("int_"):
            yield p, f"a model of {first} is named otherwise"


@project_rule("PS02", "a folder that doesn't fit its name", "info")
def _(e):
    for p in e.models:
        first, name = p.split(".")[0].lower(), p.rsplit(".", 1)[-1].lower()
        if name.startswith("stg_") and "." in p and first not in ("staging", "stg"):
            yield p, "a staging model outside staging"


@project_rule("PL01", "a star on a source", "info")
def _(e):
    for p, m in e.models.items():
        if m.uses_star and e.external.get(p):
            yield p, "a change of the source's columns passes through unseen"


@project_rule("PL02", "columns that nothing reads", "info")
def _(e):
    read = {(s.table.lower(), s.column.lower()) for m in e.models.values() for c in m.columns for s in c.sources}
    for p, m in e.models.items():
        children = [e.models[c] for c in e.dag.children[p]]
        if children and not any(c.uses_star or c.error for c in children):
            text = " ".join(c.sql.lower() for c in children)
            unread = [c.name for c in m.columns if not {(m.name.lower(), c.name.lower()), (p.lower(), c.name.lower())} & read and not re.search(rf"\b{re.escape(c.name.lower())}\b", text)]
            if unread:
                yield p, f"nothing reads {', '.join(unread[:5])}"


@project_rule("PL04", "an implicit cross join", "warning")
def _(e):
    from tessera.lint.analyzer import tree_of

    for p in e.models:
        tree = tree_of(e, p)
        for s in selects(tree) if tree is not None else ():
            if any(j.how in ("COMMA", "CROSS") for j in joins(s.source)) and s.where is None:
                yield p, "multiplies rows"
                break


@project_rule("PL05", "columns of sources changed", "warning")
def _(e):
    for p, m in e.models.items():
        if not m.uses_star:
            continue
        for s in m.sources:
            old = [r["name"] for r in e.state.rows("SELECT name, position FROM column_snapshots WHERE model = ? AND source = ? AND run_id = (SELECT run_id FROM column_snapshots WHERE model = ? AND source = ? ORDER BY taken_at DESC LIMIT 1) ORDER BY position", p, s, p, s)]
            name = e.table(e.models[e.names()[s.lower()]]) if s.lower() in e.names() else s
            if old and e.spark.catalog.tableExists(name):
                new = e.spark.table(name).columns
                if gone := [c for c in old if c not in new]:
                    yield p, f"{s} lost {', '.join(gone)}"
                if more := [c for c in new if c not in old]:
                    yield p, f"{s} gained {', '.join(more)}"


__all__ = ["Issue", "PROJECT_RULES", "SQL_RULES", "layer"]
