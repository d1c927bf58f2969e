"""Python files as facts: declarations, imports, calls and references, resolved within each file."""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACT = "path string, fact string, name string, qualified_name string, owner string, target string, line int, error string"


class _Collector(ast.NodeVisitor):
    def __init__(self) -> None:
        self.scope: list[str] = []
        self.rows: list[tuple] = []
        self.by_name: dict[str, list[str]] = defaultdict(list)
        self.seen: list[tuple[str, str, str, int]] = []

    def _declare(self, node: ast.AST, kind: str) -> None:
        qualified = ".".join([*self.scope, node.name])
        self.rows.append((kind, node.name, qualified, ".".join(self.scope) or None, None, node.lineno))
        self.by_name[node.name].append(qualified)
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._declare(node, "class")

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._declare(node, "method" if self.scope and self.rows and any(r[0] == "class" and r[2] == ".".join(self.scope) for r in self.rows) else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        self.rows += [("import", a.name, None, ".".join(self.scope) or None, a.asname, node.lineno) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.rows += [("import", f"{module}.{a.name}".lstrip() if module.strip(".") else module + a.name, None, ".".join(self.scope) or None, a.asname, node.lineno) for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
        if name:
            self.seen.append(("calls", name, ".".join(self.scope), node.lineno))
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.seen.append(("references", node.id, ".".join(self.scope), node.lineno))

    def facts(self) -> Iterator[tuple]:
        yield from self.rows
        for kind, name, owner, line in self.seen:
            targets = self.by_name.get(name, [])
            for t in targets:  # a name with several declarations may refer to any of them
                yield (kind if len(targets) == 1 else "may_refer_to"), name, None, owner or None, t, line


def facts_of(path: str, text: str | None) -> list[tuple]:
    try:
        c = _Collector()
        c.visit(ast.parse(text or ""))
        return [(path, *f, None) for f in c.facts()]
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "failed", None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, text); a file that doesn't parse gives one failed row."""
    names = [c.split()[0] for c in FACT.split(", ")]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pd.DataFrame([f for p, t in zip(pdf["path"], pdf["text"]) for f in facts_of(p, t)], columns=names)
            yield out.astype({"line": "Int32"})

    return files.select("path", "text").mapInPandas(read, FACT)
