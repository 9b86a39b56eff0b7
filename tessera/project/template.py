"""Text templates: {{ expression }}, {* for x in e: *}, {* if e: *}, {* elif e: *}, {* else: *}, {* endfor *}, {* endif *}.

Expressions are a sandboxed subset of Python, walked as a syntax tree: no imports, no attribute that starts
with an underscore, only listed methods and built-ins.
"""

from __future__ import annotations

import ast
import operator
import re
from typing import Any


class TemplateError(ValueError):
    pass


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.BitOr: operator.or_, ast.BitAnd: operator.and_}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: operator.is_, ast.IsNot: operator.is_not}
BUILTINS = {f.__name__: f for f in (len, str, int, float, bool, list, dict, tuple, set, range, enumerate, zip, sorted, reversed, min, max, abs, sum, any, all, repr)} | {"True": True, "False": False, "None": None}
_METHODS = {
    str: set("upper lower strip lstrip rstrip split join replace startswith endswith format title capitalize count find index splitlines isdigit isalpha removeprefix removesuffix".split()),
    list: set("append extend index count insert pop remove".split()),
    dict: set("get keys values items pop update setdefault".split()),
    tuple: set("index count".split()),
}
_LOOPS = 1_000_000


class Namespace:
    """Attributes for expressions; a missing one is an error."""

    def __init__(self, name: str, values: dict[str, Any]):
        self.name, self.values = name, values


class _Return(Exception):
    def __init__(self, value):
        self.value = value


class _Loop(Exception):
    pass


class Evaluator:
    def __init__(self, scope: dict[str, Any]):
        self.scopes = [BUILTINS, scope]
        self.steps = 0

    def lookup(self, name: str):
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        raise TemplateError(f"undefined name {name!r}")

    def text(self, source: str):
        try:
            tree = ast.parse(source.strip(), mode="eval")
        except SyntaxError as e:
            raise TemplateError(f"can't read the expression {source.strip()!r}: {e.msg}") from None
        return self.eval(tree.body)

    def eval(self, n: ast.AST):
        f = getattr(self, "v_" + type(n).__name__, None)
        if f is None:
            raise TemplateError(f"{type(n).__name__} isn't allowed in templates")
        return f(n)

    def v_Constant(self, n):
        return n.value

    def v_Name(self, n):
        return self.lookup(n.id)

    def v_List(self, n):
        return [self.eval(x) for x in n.elts]

    def v_Tuple(self, n):
        return tuple(self.eval(x) for x in n.elts)

    def v_Set(self, n):
        return {self.eval(x) for x in n.elts}

    def v_Dict(self, n):
        return {self.eval(k): self.eval(v) for k, v in zip(n.keys, n.values)}

    def v_BinOp(self, n):
        f = _BINARY.get(type(n.op))
        if f is None:
            raise TemplateError(f"the operator {type(n.op).__name__} isn't allowed")
        a, b = self.eval(n.left), self.eval(n.right)
        if f is operator.mul and isinstance(a, (str, list)) and isinstance(b, int) and len(a) * b > _LOOPS:
            raise TemplateError("a repeated value is too long")
        return f(a, b)

    def v_BoolOp(self, n):
        value = None
        for x in n.values:
            value = self.eval(x)
            if bool(value) == isinstance(n.op, ast.Or):
                return value
        return value

    def v_UnaryOp(self, n):
        v = self.eval(n.operand)
        return not v if isinstance(n.op, ast.Not) else -v if isinstance(n.op, ast.USub) else +v

    def v_Compare(self, n):
        left = self.eval(n.left)
        for op, x in zip(n.ops, n.comparators):
            right = self.eval(x)
            if not _COMPARE[type(op)](left, right):
                return False
            left = right
        return True

    def v_IfExp(self, n):
        return self.eval(n.body) if self.eval(n.test) else self.eval(n.orelse)

    def v_Subscript(self, n):
        v = self.eval(n.value)
        if isinstance(n.slice, ast.Slice):
            part = slice(*(self.eval(x) if x else None for x in (n.slice.lower, n.slice.upper, n.slice.step)))
            return v[part]
        key = self.eval(n.slice)
        if isinstance(v, Namespace):
            v = v.values
        try:
            return v[key]
        except (KeyError, IndexError, TypeError) as e:
            raise TemplateError(f"no item {key!r}: {e}") from None

    def v_Attribute(self, n):
        v = self.eval(n.value)
        if n.attr.startswith("_"):
            raise TemplateError(f"the attribute {n.attr!r} is private")
        if isinstance(v, Namespace):
            if n.attr not in v.values:
                raise TemplateError(f"{v.name} has no {n.attr!r}")
            return v.values[n.attr]
        if isinstance(v, dict) and n.attr in v:
            return v[n.attr]
        for kind, names in _METHODS.items():
            if isinstance(v, kind) and n.attr in names:
                return getattr(v, n.attr)
        raise TemplateError(f"{type(v).__name__} has no {n.attr!r}")

    def v_Call(self, n):
        f = self.eval(n.func)
        args = []
        for a in n.args:
            args.extend(self.eval(a.value)) if isinstance(a, ast.Starred) else args.append(self.eval(a))
        kw = {}
        for k in n.keywords:
            kw.update(self.eval(k.value)) if k.arg is None else kw.__setitem__(k.arg, self.eval(k.value))
        if getattr(f, "__name__", "") == "format" and isinstance(getattr(f, "__self__", None), str) and re.search(r"\{[^}]*[._\[]", f.__self__):
            raise TemplateError("format fields can't reach into values")
        if not callable(f):
            raise TemplateError(f"{ast.unparse(n.func)} isn't callable")
        try:
            return f(*args, **kw)
        except (TypeError, ValueError) as e:
            if isinstance(e, TemplateError):
                raise
            raise TemplateError(f"{ast.unparse(n.func)}: {e}") from None

    def v_JoinedStr(self, n):
        return "".join(str(self.eval(x)) if isinstance(x, ast.Constant) else str(self.eval(x.value)) for x in n.values)

    def v_Lambda(self, n):
        return Function("lambda", n.args, [ast.Return(n.body)], self)

    def comprehension(self, generators, make):
        out = []

        def go(k):
            if k == len(generators):
                out.append(make())
                return
            g = generators[k]
            for x in self.eval(g.iter):
                self.count()
                self.assign(g.target, x)
                if all(self.eval(c) for c in g.ifs):
                    go(k + 1)

        self.scopes.append({})
        try:
            go(0)
        finally:
            self.scopes.pop()
        return out

    def v_ListComp(self, n):
        return self.comprehension(n.generators, lambda: self.eval(n.elt))

    v_GeneratorExp = v_ListComp

    def v_DictComp(self, n):
        return dict(self.comprehension(n.generators, lambda: (self.eval(n.key), self.eval(n.value))))

    def count(self):
        self.steps += 1
        if self.steps > _LOOPS:
            raise TemplateError("too many steps")

    def assign(self, target, value):
        if isinstance(target, ast.Name):
            self.scopes[-1][target.id] = value
        elif isinstance(target, (ast.Tuple, ast.List)):
            values = list(value)
            if len(values) != len(target.elts):
                raise TemplateError("a loop's names and values differ in number")
            for t, v in zip(target.elts, values):
                self.assign(t, v)
        elif isinstance(target, ast.Subscript):
            self.eval(target.value)[self.eval(target.slice)] = value
        else:
            raise TemplateError("can't assign to that")

    def run(self, body: list[ast.stmt]):
        for s in body:
            self.count()
            if isinstance(s, ast.Return):
                raise _Return(self.eval(s.value) if s.value else None)
            if isinstance(s, ast.Expr):
                self.eval(s.value)
            elif isinstance(s, ast.Assign):
                v = self.eval(s.value)
                for t in s.targets:
                    self.assign(t, v)
            elif isinstance(s, ast.AugAssign):
                self.assign(s.target, _BINARY[type(s.op)](self.eval(s.target), self.eval(s.value)))
            elif isinstance(s, ast.If):
                self.run(s.body if self.eval(s.test) else s.orelse)
            elif isinstance(s, ast.For):
                for x in self.eval(s.iter):
                    self.count()
                    self.assign(s.target, x)
                    try:
                        self.run(s.body)
                    except _Loop as e:
                        if e.args[0] == "break":
                            break
            elif isinstance(s, (ast.Break, ast.Continue)):
                raise _Loop(type(s).__name__.lower())
            elif isinstance(s, ast.FunctionDef):
                self.scopes[-1][s.name] = Function(s.name, s.args, s.body, self, ast.get_docstring(s) or "", s.lineno)
            elif not isinstance(s, ast.Pass):
                raise TemplateError(f"{type(s).__name__} isn't allowed in macros")


class Function:
    """A macro or lambda: defaults, *args and **kwargs as in Python."""

    def __init__(self, name: str, args: ast.arguments, body: list[ast.stmt], home: Evaluator, doc: str = "", line: int = 0):
        self.name, self.args, self.body, self.home, self.doc, self.line = name, args, body, home, doc, line
        self.__name__ = name
        self.defaults = [home.eval(d) for d in args.defaults]
        self.named = {a.arg: home.eval(d) for a, d in zip(args.kwonlyargs, args.kw_defaults) if d is not None}
        self.scopes = list(home.scopes)

    @property
    def signature(self) -> list[str]:
        names = [a.arg for a in self.args.args]
        k = len(names) - len(self.defaults)
        out = [n if i < k else f"{n}={self.defaults[i - k]!r}" for i, n in enumerate(names)]
        return out + ([f"*{self.args.vararg.arg}"] if self.args.vararg else []) + ([f"**{self.args.kwarg.arg}"] if self.args.kwarg else [])

    def __call__(self, *args, **kw):
        names = [a.arg for a in self.args.args]
        scope = self.named | dict(zip(names[len(names) - len(self.defaults) :], self.defaults))
        if len(args) > len(names) and not self.args.vararg:
            raise TypeError(f"{self.name} takes {len(names)} arguments, not {len(args)}")
        scope.update(zip(names, args))
        if self.args.vararg:
            scope[self.args.vararg.arg] = tuple(args[len(names) :])
        extra = {}
        for k, v in kw.items():
            (scope if k in names or k in [a.arg for a in self.args.kwonlyargs] else extra)[k] = v
        if extra and not self.args.kwarg:
            raise TypeError(f"{self.name} has no argument {next(iter(extra))!r}")
        if self.args.kwarg:
            scope[self.args.kwarg.arg] = extra
        for n in names:
            if n not in scope:
                raise TypeError(f"{self.name} needs the argument {n!r}")
        e = Evaluator({})
        e.scopes = [*self.scopes, scope]
        try:
            e.run(self.body)
        except _Return as r:
            return r.value
        return None


def load_macros(source: str, scope: dict[str, Any] | None = None) -> dict[str, Function]:
    """The public functions of a macro file."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        raise TemplateError(f"line {e.lineno}: {e.msg}") from None
    e = Evaluator(dict(scope or {}))
    e.run([s for s in tree.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))])
    return {k: v for k, v in e.scopes[-1].items() if isinstance(v, Function) and not k.startswith("_")}


_PIECE = re.compile(r"\{\{|\{\*")


def _pieces(text: str):
    """("text" | "expr" | "statement", content, line)."""
    i = 0
    while m := _PIECE.search(text, i):
        if m.start() > i:
            yield "text", text[i : m.start()], text.count("\n", 0, i) + 1
        line = text.count("\n", 0, m.start()) + 1
        if m[0] == "{*":
            end = text.find("*}", m.end())
            if end < 0:
                raise TemplateError(f"line {line}: {{* isn't closed")
            yield "statement", text[m.end() : end].strip(), line
            i = end + 2
            continue
        depth, j, quote = 0, m.end(), None
        while j < len(text):
            c = text[j]
            if quote:
                j += c == "\\"
                quote = None if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                if not depth and text.startswith("}}", j):
                    break
                depth -= 1
            j += 1
        else:
            raise TemplateError(f"line {line}: {{{{ isn't closed")
        yield "expr", text[m.end() : j].strip(), line
        i = j + 2
    if i < len(text):
        yield "text", text[i:], text.count("\n", 0, i) + 1


def _tree(text: str) -> list:
    root: list = []
    stack: list[tuple[str, list, int]] = [("", root, 0)]
    for kind, content, line in _pieces(text):
        if kind != "statement":
            stack[-1][1].append((kind, content, line))
            continue
        word = content.rstrip(":").split(None, 1)
        head = word[0] if word else ""
        if head == "for":
            m = re.fullmatch(r"for\s+(.+?)\s+in\s+(.+?):?", content, re.S)
            if not m:
                raise TemplateError(f"line {line}: can't read {content!r}")
            body: list = []
            stack[-1][1].append(("for", m[1], m[2], body, line))
            stack.append(("for", body, line))
        elif head == "if":
            branches = [(content[2:].strip().rstrip(":"), [])]
            stack[-1][1].append(("if", branches, line))
            stack.append(("if", branches[0][1], line))
        elif head in ("elif", "else"):
            if stack[-1][0] != "if":
                raise TemplateError(f"line {line}: {head} without if")
            stack.pop()
            branches = next(x for x in reversed(stack[-1][1]) if x[0] == "if")[1]
            branches.append((content[4:].strip().rstrip(":") if head == "elif" else "True", []))
            stack.append(("if", branches[-1][1], line))
        elif head in ("endfor", "endif"):
            if stack[-1][0] != head[3:]:
                raise TemplateError(f"line {line}: {head} without {head[3:]}")
            stack.pop()
        else:
            raise TemplateError(f"line {line}: unknown statement {content!r}")
    if len(stack) > 1:
        raise TemplateError(f"line {stack[-1][2]}: {stack[-1][0]} isn't closed")
    return root


def render(text: str, scope: dict[str, Any]) -> str:
    e = Evaluator(dict(scope))

    def shown(v) -> str:
        return "" if v is None else v if isinstance(v, str) else repr(v)

    def go(nodes: list) -> str:
        out = []
        for n in nodes:
            try:
                if n[0] == "text":
                    out.append(n[1])
                elif n[0] == "expr":
                    out.append(shown(e.text(n[1])))
                elif n[0] == "if":
                    out.append(next((go(body) for cond, body in n[1] if e.text(cond)), ""))
                else:
                    target = ast.parse(n[1]).body[0].value
                    e.scopes.append({})
                    for x in e.text(n[2]):
                        e.count()
                        e.assign(target, x)
                        out.append(go(n[3]))
                    e.scopes.pop()
            except TemplateError as x:
                raise x if str(x).startswith("line ") else TemplateError(f"line {n[-1]}: {x}") from None
        return "".join(out)

    return go(_tree(text))
