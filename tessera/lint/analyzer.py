"""Runs the rules; the health score of a project."""

from __future__ import annotations

from tessera.lint.rules import PROJECT_RULES, SQL_RULES, Issue
from tessera.plans.lexer import SqlError
from tessera.plans.nodes import Node
from tessera.plans.parser import parse
from tessera.project.template import TemplateError

SEVERITIES = ("error", "warning", "info", "hint")


def lint_sql(sql: str, dialect: str = "duckdb", disabled: frozenset[str] = frozenset(), severities: dict[str, str] | None = None, model: str = "") -> list[Issue]:
    try:
        tree = parse(sql, dialect)
    except SqlError as e:
        return [Issue("PARSE", "error", str(e), 0, model)]
    out = []
    for rule, (_, severity, check) in SQL_RULES.items():
        if rule not in disabled:
            out += [Issue(rule, (severities or {}).get(rule, severity), message, line, model) for line, message in check(tree)]
    return out


def tree_of(engine, path: str) -> Node | None:
    try:
        return parse(engine.render(engine.models[path]), engine.config.dialect)
    except (SqlError, TemplateError):
        return None


def lint_project(engine, disabled: frozenset[str] = frozenset(), least: str = "hint") -> list[Issue]:
    """Issues of every model and of the project, at least as severe as `least`."""
    out = []
    for p, m in engine.models.items():
        try:
            out += lint_sql(engine.render(m), engine.config.dialect, disabled, None, p)
        except TemplateError as e:
            out.append(Issue("RENDER", "error", str(e), 0, p))
    for rule, (_, severity, check) in PROJECT_RULES.items():
        if rule not in disabled:
            out += [Issue(rule, severity, message, 0, p) for p, message in check(engine)]
    return [i for i in out if SEVERITIES.index(i.severity) <= SEVERITIES.index(least)]


def health_score(issues: list[Issue], n_models: int) -> int:
    """100 less a penalty for each issue: 5, 3, 2 or 1 by the project's size, twice that for errors."""
    each = 1 if n_models > 100 else 2 if n_models > 50 else 3 if n_models > 10 else 5
    return max(0, 100 - sum(each * (2 if i.severity == "error" else 1) for i in issues if i.severity in ("error", "warning")))
