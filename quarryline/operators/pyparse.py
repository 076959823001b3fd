"""What one Python source says: symbols, imports, and names that can be resolved for certain. Plain Python, run on executors.

A source is read once into scopes: a module, its functions and classes. Each scope notes how often it binds a name, what it declares
global or nonlocal, and what it calls or reads. Afterwards a name that a function uses is looked for in the function, then in the functions
around it; if none of them has it, it is the module's. Only names that the module binds once, by a function or an import, tell what they are.
"""

from __future__ import annotations

import ast
from collections import Counter
from dataclasses import dataclass, field
from typing import NamedTuple

EMPTY = {"symbols": [], "imports": [], "bindings": [], "uses": [], "external": [], "calls": [], "names": []}
# What marks one of several declarations of a function.
OVERLOADS = ("typing.overload", "typing_extensions.overload")


class Target(NamedTuple):
    """What a name stands for: kind local (function of this file), module or import; dotted target with its leading dots; name there."""

    kind: str
    path: str
    symbol: str


class Use(NamedTuple):
    """A name that is called (of: the attributes up to the call, '' for the name itself) or read. inner: within a lambda, generator or postponed annotation."""

    name: str
    called: bool
    of: str
    inner: bool


@dataclass
class Scope:
    node: ast.AST
    outer: Scope | None
    path: tuple[str, ...] = ()
    bound: Counter = field(default_factory=Counter)
    taken: set[str] = field(default_factory=set)  # parameters
    shared: Counter = field(default_factory=Counter)  # declared global or nonlocal
    globals: set[str] = field(default_factory=set)
    direct: set[str] = field(default_factory=set)  # names that its own code mentions
    uses: list[Use] = field(default_factory=list)

    @property
    def is_function(self) -> bool:
        return isinstance(self.node, (ast.FunctionDef, ast.AsyncFunctionDef))

    @property
    def name(self) -> str | None:
        return ".".join(self.path) or None

    def has(self, name: str) -> bool:
        return name not in self.shared and (name in self.bound or name in self.taken)

    def times(self, name: str) -> int:
        return self.bound[name] + self.shared[name]


def imported(node: ast.Import | ast.ImportFrom) -> dict[str, Target]:
    """The names that an import statement binds."""
    if isinstance(node, ast.Import):
        whole = {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in node.names}
        return {name: Target("module", path, path) for name, path in whole.items()}
    base = "." * node.level + (f"{node.module}." if node.module else "")
    return {a.asname or a.name: Target("import", base + a.name, a.name) for a in node.names if a.name != "*"}


def chain(node: ast.AST) -> tuple[str, str] | None:
    """Name and attributes of a dotted expression."""
    attributes: list[str] = []
    while isinstance(node, ast.Attribute):
        attributes.insert(0, node.attr)
        node = node.value
    return (node.id, ".".join(attributes)) if isinstance(node, ast.Name) else None


class Source:
    """The scopes of a tree, and what all of it imports, calls and reads."""

    def __init__(self, tree: ast.Module):
        self.module = Scope(tree, None)
        # annotations that are never evaluated aren't code of their scope
        self.postponed = any(isinstance(n, ast.ImportFrom) and n.module == "__future__" and any(a.name == "annotations" for a in n.names) for n in tree.body)
        self.scopes, self.imports, self.calls, self.names = [self.module], set(), set(), set()
        self.todo: list[tuple[ast.AST, Scope, bool]] = [(n, self.module, False) for n in tree.body]
        while self.todo:
            self._read(*self.todo.pop())

    def _later(self, nodes, scope: Scope, inner: bool) -> None:
        self.todo += [(n, scope, inner) for n in nodes if n is not None]

    def _read(self, node: ast.AST, scope: Scope, inner: bool) -> None:
        rest = ast.iter_child_nodes(node)
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                scope.bound[node.name] += 1
                self._open(node, scope, inner)
                return
            case ast.Name(id=name, ctx=ast.Load()):
                self._mention(name, scope, inner)
                scope.uses.append(Use(name, False, "", inner))
                self.names.add(name)
            case ast.Name(id=name):
                self._mention(name, scope, inner)
                scope.bound[name] += 1
            case ast.Attribute(attr=attr, ctx=ast.Load()):
                self.names.add(attr)
            case ast.Call(func=ast.Name(id=name)):
                self._mention(name, scope, inner)
                scope.uses.append(Use(name, True, "", inner))
                self.names.add(name)
                self.calls.add(name)
                rest = [*node.args, *node.keywords]
            case ast.Call(func=ast.Attribute(attr=attr)):
                self.calls.add(attr)
                if found := chain(node.func):
                    scope.uses.append(Use(found[0], True, found[1], inner))
            case ast.Import() | ast.ImportFrom():
                names = [a.asname or (a.name.split(".")[0] if isinstance(node, ast.Import) else a.name) for a in node.names if a.name != "*"]
                scope.bound.update(names)
                scope.direct.update(names)
                if isinstance(node, ast.Import):
                    self.imports.update(a.name for a in node.names)
                else:
                    base = "." * node.level + (node.module or "")
                    self.imports.update({base} - {""}, (f"{base}.{a.name}" if node.module else base + a.name for a in node.names))
            case ast.Global(names=names) | ast.Nonlocal(names=names):
                scope.shared.update(names)
                if isinstance(node, ast.Global):
                    scope.globals.update(names)
            case ast.ExceptHandler(name=str(name)) | ast.MatchAs(name=str(name)) | ast.MatchStar(name=str(name)) | ast.MatchMapping(rest=str(name)):
                scope.bound[name] += 1
                scope.direct.add(name)
            case ast.AnnAssign():
                self._later([node.annotation], scope, inner or self.postponed)
                rest = [node.target, node.value]
            case ast.Lambda(args=a):
                self._later([*a.defaults, *a.kw_defaults], scope, inner)
                self._later([node.body], scope, True)
                return
            case ast.GeneratorExp(generators=[first, *_]):
                # its first iterable is evaluated outside of it
                self._later([first.iter], scope, inner)
                self._later([node.elt, first.target, *first.ifs, *node.generators[1:]], scope, True)
                return
        self._later(rest, scope, inner)

    def _mention(self, name: str, scope: Scope, inner: bool) -> None:
        if not inner:
            scope.direct.add(name)

    def _open(self, node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, scope: Scope, inner: bool) -> None:
        """A definition: its body is a scope, all else of it is evaluated around it."""
        own = Scope(node, scope, (*scope.path, node.name))
        self.scopes.append(own)
        around = [*node.decorator_list, *node.type_params]
        if isinstance(node, ast.ClassDef):
            around += [*node.bases, *(k.value for k in node.keywords)]
        else:
            a = node.args
            every = [x for x in (*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg) if x]
            own.taken = {x.arg for x in every}
            around += [*a.defaults, *a.kw_defaults]
            self._later([node.returns, *(x.annotation for x in every)], scope, inner or self.postponed)
        self._later(around, scope, inner)
        self._later(node.body, own, False)


class Names:
    """What names stand for: the module's sure ones, and those that functions import at their start."""

    def __init__(self, source: Source):
        self.module = source.module
        made: dict[str, Target] = {}
        for node in source.module.node.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                made[node.name] = Target("local", node.name, node.name)
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                made |= imported(node)
        rewritten = {n for s in source.scopes for n in s.globals if s is not self.module and n in s.bound}
        self.sure = {n: t for n, t in made.items() if self.module.times(n) == 1 and n not in rewritten}

    @staticmethod
    def leading(scope: Scope) -> dict[str, Target]:
        """From-imports at a function's start, under names that nothing else in it binds."""
        out: dict[str, Target] = {}
        for node in scope.node.body[ast.get_docstring(scope.node, clean=False) is not None :]:
            if not isinstance(node, (ast.Import, ast.ImportFrom)):
                break
            out |= imported(node) if isinstance(node, ast.ImportFrom) else {}
        return {n: t for n, t in out.items() if scope.times(n) == 1 and n not in scope.taken}

    def meaning(self, use: Use, scope: Scope, leading: dict[str, Target]) -> tuple[Target | None, bool]:
        """The target of a use, if it is certain, and whether the function imports it itself."""
        name = use.name
        if scope is self.module:
            return self.sure.get(name), False
        if name in scope.shared or (use.inner and name not in scope.direct):
            return None, False
        if scope.has(name):
            return leading.get(name), name in leading
        around = scope.outer
        while around is not None and around is not self.module:
            if around.is_function and name in around.globals:
                break
            if around.is_function and around.has(name):
                return None, False
            around = around.outer
        return self.sure.get(name), False

    def one_of_several(self, node: ast.AST) -> bool:
        """Whether a function is a declaration for typing only."""
        for mark in node.decorator_list:
            found = chain(mark.func if isinstance(mark, ast.Call) else mark)
            target = self.sure.get(found[0]) if found else None
            if target and ".".join(filter(None, (target.path, found[1]))) in OVERLOADS and (target.kind == "import") == (not found[1]):
                return True
        return False


def parse(source: str, path: str = "") -> dict[str, list]:
    """symbols (name, qualified_name, kind, line, end_line, docstring), imports (dotted), bindings (local_name, target, symbol: safe module-level from-imports),
    uses (kind call or reference, caller, local_name, target, symbol, function_local; target '' for a function of this file), external (caller, target: qualified calls), calls and names (all that are
    called and read). Nothing for a source that doesn't parse."""
    try:
        tree = ast.parse(source, path or "source")
        compile(tree, path or "source", "exec", dont_inherit=True)  # also refuses what only scopes tell, like a return outside of a function
    except (SyntaxError, ValueError, RecursionError):
        return {k: [] for k in EMPTY}
    read = Source(tree)
    names = Names(read)
    uses, external = set(), set()
    for scope in read.scopes:
        if scope is not read.module and not scope.is_function:
            continue
        leading = names.leading(scope) if scope.is_function else {}
        for use in scope.uses:
            target, own = names.meaning(use, scope, leading)
            if target is None:
                continue
            outside = target.kind != "local" and not target.path.startswith(".")
            if use.of:
                if outside:
                    external.add((scope.name, f"{target.path}.{use.of}"))
            elif target.kind == "import" and use.called:
                uses.add(("call", scope.name, use.name, target.path, target.symbol, own))
                if outside:
                    external.add((scope.name, target.path))
            elif target.kind == "import" and not own:
                uses.add(("reference", scope.name, use.name, target.path, target.symbol, False))
            elif target.kind == "local" and use.called:
                uses.add(("call", scope.name, use.name, "", target.symbol, False))
    made = read.scopes[1:]
    defined = Counter(s.name for s in made if s.is_function)
    real = Counter(s.name for s in made if s.is_function and not names.one_of_several(s.node))
    # a caller that is defined twice can't be told apart
    alone = lambda caller: caller is None or defined[caller] == 1
    order = lambda row: [str(x or "") for x in row]
    return {
        "symbols": sorted(((s.node.name, s.name, "function" if s.is_function else "class", s.node.lineno, s.node.end_lineno, ast.get_docstring(s.node)) for s in made), key=lambda s: s[3]),
        "imports": sorted(read.imports),
        "bindings": sorted((n, t.path, t.symbol) for n, t in names.sure.items() if t.kind == "import"),
        "uses": sorted((u for u in uses if alone(u[1])), key=order),
        "external": sorted((e for e in external if alone(e[0]) or real[e[0]] == 1), key=order),
        "calls": sorted(read.calls),
        "names": sorted(read.names),
    }
