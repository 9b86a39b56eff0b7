"""Model files: frontmatter, legacy pragmas and SQL."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass, field

KEYS = frozenset("name materialized unique_key owner schema tags meta tests description".split())
KINDS = ("table", "view", "incremental")


class LoadError(ValueError):
    pass


@dataclass
class Model:
    path: str
    name: str
    file: str
    sql: str
    materialized: str = "table"
    unique_key: list[str] = field(default_factory=list)
    owner: str = ""
    schema: str = ""
    description: str = ""
    tags: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=dict)
    tests: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    conditionals: list[tuple[str, str]] = field(default_factory=list)
    content_hash: str = ""
    sources: list[str] = field(default_factory=list)
    columns: list = field(default_factory=list)
    uses_star: bool = False
    error: str = ""


def yaml_value(text: str):
    """The YAML that frontmatter uses: scalars, [a, b] and {a: b}."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [yaml_value(x) for x in _commas(text[1:-1])]
    if text.startswith("{") and text.endswith("}"):
        return {k.strip(): yaml_value(v) for k, _, v in (x.partition(":") for x in _commas(text[1:-1]))}
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _commas(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "[{") - (c in "]}")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [x for x in [*out, now] if x.strip()]


def yaml(text: str):
    """Indented maps and lists of yaml_value scalars."""
    lines = [(len(x) - len(x.lstrip()), re.sub(r"\s+#.*$", "", x.strip())) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int):
        if i < len(lines) and lines[i][1].startswith("-"):
            out = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                if not rest:
                    v, i = block(i + 1, lines[i + 1][0]) if i + 1 < len(lines) and lines[i + 1][0] > indent else (None, i + 1)
                elif re.match(r"[\w-]+:(\s|$)", rest):
                    inner = indent + 2
                    lines[i] = (inner, rest)
                    v, i = block(i, inner)
                else:
                    v, i = yaml_value(rest), i + 1
                out.append(v)
            return out, i
        made = {}
        while i < len(lines) and lines[i][0] == indent:
            m = re.match(r"([\w.-]+)\s*:\s*(.*)$", lines[i][1])
            if not m:
                raise LoadError(f"can't read the line {lines[i][1]!r}")
            if m[2]:
                made[m[1]], i = yaml_value(m[2]), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > indent or lines[i + 1][0] == indent and lines[i + 1][1].startswith("-")):
                made[m[1]], i = block(i + 1, lines[i + 1][0])
            else:
                made[m[1]], i = None, i + 1
        return made, i

    if not lines:
        return {}
    value, end = block(0, lines[0][0])
    if end < len(lines):
        raise LoadError(f"can't read the line {lines[end][1]!r}")
    return value


def as_list(v) -> list:
    return [] if v is None else list(v) if isinstance(v, (list, tuple)) else [v]


def parse_model(text: str, path: str, file: str = "") -> Model:
    """A model of a file's text; `path` is its dotted path, whose last part is the default name."""
    digest = hashlib.sha256(text.encode()).hexdigest()[:16]
    head: dict = {}
    body = text
    m = re.match(r"\s*/\*---[ \t]*\n(.*?)\n?---\*/", text, re.S)
    if m:
        head = yaml(m[1]) or {}
        body = text[m.end() :]
    elif re.match(r"\s*/\*---", text):
        raise LoadError(f"{file or path}: the frontmatter isn't closed")
    if unknown := set(head) - KEYS:
        raise LoadError(f"{file or path}: unknown frontmatter key {', '.join(sorted(unknown))}")
    imports = []
    for key, value in re.findall(r"^--\s*@config\(\s*(\w+)\s*=\s*'([^']*)'\s*\)", body, re.M):
        head.setdefault(key, value)
    for names in re.findall(r"^--\s*@import\(([^)]*)\)", body, re.M):
        imports += [x.strip().strip("'\"") for x in names.split(",") if x.strip()]
    conditionals = [(c.strip(), b.strip()) for c, b in re.findall(r"^--\s*#if\s+(.*?)\n(.*?)^--\s*#endif[^\n]*$", body, re.M | re.S)]
    body = re.sub(r"^--\s*#if\s+.*?\n.*?^--\s*#endif[^\n]*$", "", body, flags=re.M | re.S)
    body = re.sub(r"^--\s*@(?:config|import)\([^)]*\)[^\n]*$", "", body, flags=re.M)
    kind = head.get("materialized", "table")
    if kind not in KINDS:
        raise LoadError(f"{file or path}: materialized is {kind!r}, not one of {', '.join(KINDS)}")
    return Model(
        path=path, name=head.get("name") or path.rsplit(".", 1)[-1], file=file, sql=body.strip().rstrip(";").strip(), materialized=kind, unique_key=[str(x) for x in as_list(head.get("unique_key"))],
        owner=head.get("owner") or "", schema=head.get("schema") or "", description=head.get("description") or "", tags=[str(x) for x in as_list(head.get("tags"))], meta=head.get("meta") or {},
        tests=[x for x in as_list(head.get("tests"))], imports=imports, conditionals=conditionals, content_hash=digest,
    )


def load_models(folder: str, reuse: dict[str, Model] | None = None) -> dict[str, Model]:
    """Models by path ("marts.summary"); a file whose hash is that of `reuse` isn't parsed again."""
    out: dict[str, Model] = {}
    for base, _, files in sorted(os.walk(folder)):
        for f in sorted(files):
            if not f.endswith(".sql"):
                continue
            full = os.path.join(base, f)
            path = os.path.relpath(full, folder)[:-4].replace(os.sep, ".")
            with open(full, encoding="utf-8") as h:
                text = h.read()
            old = (reuse or {}).get(path)
            if old and old.content_hash == hashlib.sha256(text.encode()).hexdigest()[:16]:
                out[path] = old
            else:
                out[path] = parse_model(text, path, full)
    return out
