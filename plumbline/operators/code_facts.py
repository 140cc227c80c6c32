"""Code facts from Python sources: signatures, default values, configuration leaves and import aliases.

A file is read by itself, so the extraction runs on any number of files in parallel; what needs several files, the closure over
re-exports, is a join in operators.exports.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Any

from plumbline.functions.ids import Blob, stable_id
from plumbline.functions.literals import PARSE_FAULTS, encode_literal

UNKNOWN = object()
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
DEFINITIONS = (*FUNCTIONS, ast.ClassDef)
PLAIN_DECORATORS = {"staticmethod", "classmethod"}
VERSION = "code/1"


@dataclass
class Scope:
    """What is proven about a module's names at one moment."""

    values: dict[str, Any] = field(default_factory=dict)
    makers: dict[str, Any] = field(default_factory=dict)  # zero-argument functions that return one literal
    dict_is_builtin: bool = True

    def snapshot(self) -> Scope:
        return Scope(dict(self.values), dict(self.makers), self.dict_is_builtin)

    def forget(self, name: str) -> None:
        self.values.pop(name, None)
        self.makers.pop(name, None)
        if name == "dict":
            self.dict_is_builtin = False

    def bind(self, name: str, value: Any) -> None:
        self.forget(name)
        if value is not UNKNOWN:
            self.values[name] = value


class Folder:
    """Folds literal expressions; anything with an effect or an unproven name is UNKNOWN."""

    def __init__(self, scope: Scope):
        self.scope = scope

    def __call__(self, node: ast.AST | None) -> Any:
        handler = getattr(self, "on_" + type(node).__name__.lower(), None)
        return handler(node) if handler else UNKNOWN

    def _all(self, nodes: list[ast.expr]) -> list | None:
        found = [self(n) for n in nodes]
        return None if any(v is UNKNOWN for v in found) else found

    @staticmethod
    def _literal(value: Any) -> Any:
        return UNKNOWN if encode_literal(value) is None else value

    def on_constant(self, node: ast.Constant) -> Any:
        return self._literal(node.value)

    def on_name(self, node: ast.Name) -> Any:
        return self.scope.values.get(node.id, UNKNOWN)

    def on_list(self, node: ast.List) -> Any:
        found = self._all(node.elts)
        return UNKNOWN if found is None else found

    def on_tuple(self, node: ast.Tuple) -> Any:
        found = self._all(node.elts)
        return UNKNOWN if found is None else tuple(found)

    def on_set(self, node: ast.Set) -> Any:
        found = self._all(node.elts)
        try:
            return UNKNOWN if found is None else set(found)
        except TypeError:
            return UNKNOWN

    def on_dict(self, node: ast.Dict) -> Any:
        built: dict = {}
        for k, v in zip(node.keys, node.values):
            value = self(v)
            if value is UNKNOWN:
                return UNKNOWN
            if k is None:
                if type(value) is not dict:
                    return UNKNOWN
                built |= value
                continue
            key = self(k)
            try:
                if key is UNKNOWN:
                    return UNKNOWN
                built[key] = value
            except TypeError:
                return UNKNOWN
        return self._literal(built)

    def on_unaryop(self, node: ast.UnaryOp) -> Any:
        value = self(node.operand)
        if type(value) not in (int, float):
            return UNKNOWN
        return {ast.UAdd: value, ast.USub: -value}.get(type(node.op), UNKNOWN)

    def on_binop(self, node: ast.BinOp) -> Any:
        return self.combine(self(node.left), node.op, self(node.right))

    def combine(self, a: Any, op: ast.operator, b: Any) -> Any:
        numbers = type(a) in (int, float) and type(b) in (int, float)
        joinable = type(a) is type(b) and type(a) in (str, tuple, list)
        try:
            if isinstance(op, ast.Add) and (numbers or joinable):
                return self._literal(a + b)
            if isinstance(op, ast.Sub) and numbers:
                return self._literal(a - b)
        except (OverflowError, ValueError, MemoryError):
            pass
        return UNKNOWN

    def on_call(self, node: ast.Call) -> Any:
        if not isinstance(node.func, ast.Name) or node.args:
            return UNKNOWN
        if node.func.id in self.scope.makers and not node.keywords:
            return self.scope.makers[node.func.id]
        if node.func.id != "dict" or not self.scope.dict_is_builtin or any(k.arg is None for k in node.keywords):
            return UNKNOWN
        found = self._all([k.value for k in node.keywords])
        return UNKNOWN if found is None else dict(zip([k.arg for k in node.keywords], found))


def literal_return(node: ast.AST, scope: Scope) -> Any:
    """What a function returns that takes nothing and only returns a literal."""
    a = getattr(node, "args", None)
    plain = isinstance(node, ast.FunctionDef) and not node.decorator_list and not (a.posonlyargs or a.args or a.kwonlyargs or a.vararg or a.kwarg)
    match node.body if plain else None:
        case [ast.Return(value=returned)]:
            return Folder(scope)(returned)
    return UNKNOWN


def root_name(node: ast.AST) -> str | None:
    while isinstance(node, (ast.Attribute, ast.Subscript)):
        node = node.value
    return node.id if isinstance(node, ast.Name) else None


def changed_names(statement: ast.AST) -> set[str]:
    """Names that a statement stores or deletes, those whose attributes or items it stores or deletes included."""
    names = set()
    for n in ast.walk(statement):
        if isinstance(getattr(n, "ctx", None), (ast.Store, ast.Del)):
            if isinstance(n, ast.Name):
                names.add(n.id)
            elif isinstance(n, (ast.Attribute, ast.Subscript)) and (root := root_name(n)):
                names.add(root)
    return names


@dataclass
class Leaf:
    """One explicit value within a configuration name: where it stands and what it is."""

    node: ast.AST
    value: Any


Leaves = dict[tuple[str, ...], Leaf]


def leaves_of(node: ast.expr, fold: Folder, at: tuple[str, ...] = ()) -> Leaves:
    """Values under string keys, by key path. A dynamic entry makes the values before it unknown, a repeated key its own."""
    match node:
        case ast.Call(func=ast.Name(id="dict"), args=positional, keywords=named):
            explicit = fold.scope.dict_is_builtin and not positional and None not in {k.arg for k in named}
            return {(*at, k.arg): Leaf(k.value, fold(k.value)) for k in named} if explicit else {}
    if not isinstance(node, ast.Dict):
        return {at: Leaf(node, fold(node))}
    out: Leaves = {}
    seen = set()
    for k, v in zip(node.keys, node.values):
        if not (isinstance(k, ast.Constant) and isinstance(k.value, str)):
            blur(out)
            continue
        here = (*at, k.value)
        under = {p: leaf for p, leaf in out.items() if p[: len(here)] == here}
        inner = leaves_of(v, fold, here)
        if k.value in seen:
            blur(under)
            blur(inner)
        else:
            for p in under:
                del out[p]
        out |= inner
        seen.add(k.value)
    return out


def blur(found: Leaves) -> None:
    for path in found:
        found[path].value = UNKNOWN


class Module:
    """Runs a module's statements in order, as far as they are proven, and keeps the scope at each definition."""

    def __init__(self, tree: ast.Module):
        self.scope = Scope()
        self.at_definition: dict[int, Scope] = {}
        self.config: dict[str, Leaves] = {}
        self.first: dict[str, ast.stmt] = {}
        for statement in tree.body:
            self._run(statement)

    def _run(self, s: ast.stmt) -> None:
        if isinstance(s, DEFINITIONS):
            self.at_definition[id(s)] = self.scope.snapshot()
            made = literal_return(s, self.scope)
            self.scope.forget(s.name)
            if made is not UNKNOWN:
                self.scope.makers[s.name] = made
            return
        handled: set[str] = set()
        if isinstance(s, (ast.Assign, ast.AnnAssign)):
            handled = self._assign(s)
        elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
            handled = {s.target.id}
            fold = Folder(self.scope)
            value = fold.combine(self.scope.values.get(s.target.id, UNKNOWN), s.op, fold(s.value))
            self.scope.bind(s.target.id, value)
            if s.target.id in self.config:
                self.config[s.target.id] = {(): Leaf(s, value)}
        elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and s.value.func.attr == "update" and isinstance(s.value.func.value, ast.Name):
            handled = {s.value.func.value.id}
            self._update(s.value.func.value.id, s.value)
        for name in changed_names(s) - handled:
            self.scope.forget(name)
        mentioned = {n.id for n in ast.walk(s) if isinstance(n, ast.Name)} - handled
        for name in mentioned & self.config.keys():
            blur(self.config[name])

    def _assign(self, s: ast.Assign | ast.AnnAssign) -> set[str]:
        value = Folder(self.scope)(s.value)
        names = [t.id for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) if isinstance(t, ast.Name)]
        for name in names:
            self.scope.bind(name, value)
        for name in names:
            if name.isupper() and s.value is not None:
                self.first.setdefault(name, s)
                self.config[name] = leaves_of(s.value, Folder(self.scope))
        return set(names)

    def _update(self, name: str, call: ast.Call) -> None:
        fold, new = Folder(self.scope), None
        if not call.keywords and len(call.args) == 1:
            (new,) = call.args
        elif not call.args and all(k.arg is not None for k in call.keywords):
            new = ast.Dict([ast.Constant(k.arg) for k in call.keywords], [k.value for k in call.keywords])
        old, value = self.scope.values.get(name, UNKNOWN), fold(new)
        if type(old) is not dict or type(value) is not dict:
            self.scope.values.pop(name, None)
            blur(self.config.get(name, {}))
            return
        self.scope.values[name] = old | value
        if name not in self.config:
            return
        state, fresh = self.config[name], leaves_of(new, fold)
        if () in fresh:
            blur(state)
            return
        replaced = {path[0] for path in fresh}
        for path in [p for p in state if p[:1] and p[0] in replaced]:
            del state[path]
        state |= fresh


class Reader:
    """All rows of one source file."""

    def __init__(self, repo_id: str, path: str, data: bytes):
        self.repo_id, self.blob = repo_id, Blob(path, data)
        self.entities: list[dict] = []
        self.facts: list[dict] = []
        self.imports: list[dict] = []
        self.diagnostics: list[dict] = []
        self.module = path.removesuffix(".py").replace("/", ".").removesuffix(".__init__")
        self.line_starts = [0, *accumulate(map(len, data.splitlines(keepends=True)))]
        try:
            tree = ast.parse(data.decode(), filename=path)
            state = Module(tree)
        except PARSE_FAULTS:
            self.note("PYTHON_PARSE_ERROR", "The file can't be parsed as Python")
            return
        self.read_body(tree.body, (), True, state, Scope())
        self.read_config(state)
        self.read_imports(tree)

    def note(self, code: str, message: str) -> None:
        self.diagnostics.append({"repo_id": self.repo_id, "path": self.blob.path, "stage": "extraction", "message": message, "code": code, "affects_completeness": True, "retryable": False})

    def place(self, node: ast.AST) -> tuple[int, int]:
        start = self.line_starts[node.lineno - 1] + node.col_offset
        return start, self.line_starts[node.end_lineno - 1] + node.end_col_offset

    def source(self, node: ast.AST) -> str:
        a, b = self.place(node)
        return self.blob.data[a:b].decode()

    def add_fact(self, **columns: Any) -> None:
        blank = {"parameters": [], "provenance": [], "receiver": "none", "typed_value": None, "fact_kind": "DEFAULT_VALUE"}
        self.facts.append(blank | {"repo_id": self.repo_id, "seq": len(self.facts)} | columns)

    def read_body(self, body: list[ast.stmt], owners: tuple[str, ...], safe: bool, state: Module, scope: Scope) -> None:
        names = Counter(s.name for s in body if isinstance(s, DEFINITIONS))
        rebound = {n for n, times in names.items() if times > 1}
        for s in body:
            if isinstance(s, DEFINITIONS):
                continue
            if isinstance(s, (ast.Import, ast.ImportFrom)):
                rebound |= {a.asname or a.name.partition(".")[0] for a in s.names}
            if any(isinstance(n, DEFINITIONS) for n in ast.walk(s)):
                self.note("CONDITIONAL_DEFINITION", "A definition depends on a condition")
            rebound |= {n.id for n in ast.walk(s) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del))}
            rebound |= {r for n in ast.walk(s) if isinstance(n, ast.Attribute) and isinstance(n.ctx, (ast.Store, ast.Del)) and (r := root_name(n))}
        for s in body:
            here = state.at_definition.get(id(s), scope)
            if isinstance(s, ast.ClassDef) and not s.name.startswith("_"):
                sound = safe and s.name not in rebound and not (s.decorator_list or s.bases or s.keywords)
                self.read_body(s.body, (*owners, s.name), sound, state, here)
            elif isinstance(s, FUNCTIONS) and (s.name == "__init__" or not s.name.startswith("_")):
                self.read_function(s, owners, safe, rebound, here)

    def read_function(self, f: ast.FunctionDef | ast.AsyncFunctionDef, owners: tuple[str, ...], safe: bool, rebound: set[str], scope: Scope) -> None:
        name = ".".join([self.module, *owners, f.name])
        entity = stable_id("entity", self.blob.path, name, str(f.lineno))
        decorators = [ast.unparse(d) for d in f.decorator_list]
        safe = safe and f.name not in rebound and all(d in PLAIN_DECORATORS and d not in rebound for d in decorators)
        if not safe:
            self.note("DYNAMIC_FUNCTION", "A decorator or a rebinding may change this interface")
        parameters = []
        for arg, kind, default in self._parameters(f):
            known = encode_literal(v) if default is not None and safe and (v := Folder(scope)(default)) is not UNKNOWN else None
            state = "ABSENT" if default is None else "UNKNOWN" if known is None else "KNOWN"
            text = None if default is None else self.source(default)
            parameters.append({"name": arg.arg, "kind": kind, "required": default is None and not kind.startswith("VAR_"), "value_state": state, "typed_value": known, "expression": text})
            if default is not None:
                self.add_fact(fact_id=stable_id("fact", entity, arg.arg, self.blob.hash), entity_id=entity, subject=name, property=arg.arg, value_state=state, typed_value=known, expression=text, span=self.blob.span(*self.place(default)))
        start, end = self.place(f)
        span = self.blob.span(start, end)
        kind = "method" if owners else "async_function" if isinstance(f, ast.AsyncFunctionDef) else "function"
        self.entities.append({"repo_id": self.repo_id, "entity_id": entity, "kind": kind, "qualified_name": name, "module": self.module, "signature": parameters, "decorators": decorators, "span": span})
        receiver = "class" if "classmethod" in decorators else "instance" if owners and "staticmethod" not in decorators else "none"
        self.add_fact(fact_id=stable_id("signature", entity, self.blob.hash), entity_id=entity, value_state="KNOWN" if safe else "UNKNOWN", parameters=parameters, receiver=receiver, property="__signature__", subject=name, fact_kind="SIGNATURE", span=span, expression=self.blob.data[start:end].decode())

    @staticmethod
    def _parameters(f: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[tuple[ast.arg, str, ast.expr | None]]:
        a = f.args
        ordered = [(x, "POSITIONAL_ONLY") for x in a.posonlyargs] + [(x, "POSITIONAL_OR_KEYWORD") for x in a.args]
        absent: list[ast.expr | None] = [None] * (len(ordered) - len(a.defaults))
        yield from ((x, kind, d) for (x, kind), d in zip(ordered, absent + a.defaults))
        yield from ((x, "KEYWORD_ONLY", d) for x, d in zip(a.kwonlyargs, a.kw_defaults))
        yield from ((x, kind, None) for x, kind in ((a.vararg, "VAR_POSITIONAL"), (a.kwarg, "VAR_KEYWORD")) if x is not None)

    def read_config(self, state: Module) -> None:
        for name, leaves in state.config.items():
            entity = stable_id("config", self.blob.path, name)
            self.entities.append({"repo_id": self.repo_id, "entity_id": entity, "kind": "config", "qualified_name": f"{self.module}.{name}", "module": self.module, "signature": [], "decorators": [], "span": self.blob.span(*self.place(state.first[name]))})
            for path, leaf in leaves.items():
                *inner, last = (name, *path)
                subject = ".".join([self.module, *inner])
                known = None if leaf.value is UNKNOWN else encode_literal(leaf.value)
                self.add_fact(fact_id=stable_id("config", entity, subject, last, self.blob.hash), entity_id=entity, subject=subject, property=last, value_state="UNKNOWN" if known is None else "KNOWN", typed_value=known, expression=self.source(leaf.node), span=self.blob.span(*self.place(leaf.node)), fact_kind="CONFIG")

    def read_imports(self, tree: ast.Module) -> None:
        """Names that `from m import n` binds and nothing else in the module does."""
        bound: Counter[str] = Counter()
        found = []
        for s in tree.body:
            if isinstance(s, ast.ImportFrom):
                found += [(s, a, a.asname or a.name) for a in s.names if a.name != "*"]
                bound.update(a.asname or a.name for a in s.names if a.name != "*")
            elif isinstance(s, ast.Import):
                bound.update(a.asname or a.name.partition(".")[0] for a in s.names)
            elif isinstance(s, DEFINITIONS):
                bound[s.name] += 1
            else:
                stored = {n.id for n in ast.walk(s) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del))}
                bound.update(stored | {n.name for n in ast.walk(s) if isinstance(n, DEFINITIONS)})
        for s, alias, name in found:
            source = self._source_module(s)
            if bound[name] == 1 and source:
                self.imports.append({"repo_id": self.repo_id, "module": self.module, "path": self.blob.path, "source_module": source, "name": alias.name, "binding": name, "span": self.blob.span(*self.place(s))})

    def _source_module(self, s: ast.ImportFrom) -> str | None:
        if s.module is None or not s.level:
            return s.module
        package = self.module.split(".")
        up = s.level - (1 if self.blob.path.endswith("/__init__.py") else 0)
        return ".".join([*package[: len(package) - up], s.module]) if up <= len(package) else None


def read_source(repo_id: str, path: str, data: bytes) -> dict:
    r = Reader(repo_id, path, data)
    return {"repo_id": repo_id, "entities": r.entities, "facts": r.facts, "imports": r.imports, "diagnostics": r.diagnostics}
