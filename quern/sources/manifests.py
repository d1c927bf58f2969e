"""Build manifests and Markdown: one fact list a file; a malformed file gives an error row and hurts no other."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACT = "path string, fact string, name string, detail string, scope string, error string"


def go_mod(text: str) -> Iterator[tuple]:
    text = re.sub(r"//[^\n]*", "", text)
    if m := re.search(r"^\s*module\s+(\S+)", text, re.M):
        yield "module", m[1].strip('"'), None, None
    for verb in ("require", "use"):
        lines = [x for block in re.findall(rf"^\s*{verb}\s*\((.*?)\)", text, re.M | re.S) for x in block.split("\n")]
        lines += re.findall(rf"^\s*{verb}\s+([^(\n]+)$", text, re.M)
        for parts in filter(None, (x.split() for x in lines)):
            yield ("dependency" if verb == "require" else "member"), parts[0].strip('"'), (parts[1] if len(parts) > 1 else None), "runtime"


def package_json(text: str) -> Iterator[tuple]:
    j = json.loads(text)
    if not isinstance(j, dict):
        raise ValueError("not an object")
    yield "package", j.get("name"), j.get("version"), None
    for field, scope in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, version in sorted((j.get(field) or {}).items()):
            yield "dependency", name, str(version), scope


def _version(v: object) -> str | None:
    return v if isinstance(v, str) else v.get("version") if isinstance(v, dict) else None


def cargo_toml(text: str) -> Iterator[tuple]:
    t = tomllib.loads(text)
    if p := t.get("package"):
        yield "package", p.get("name"), _version(p.get("version")), None
    for table in [t, *t.get("target", {}).values()]:
        for field, scope in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
            for name, v in table.get(field, {}).items():
                yield "dependency", (v.get("package", name) if isinstance(v, dict) else name), _version(v), "optional" if isinstance(v, dict) and v.get("optional") else scope
    for member in t.get("workspace", {}).get("members", []):
        yield "member", member, None, None


def pyproject_toml(text: str) -> Iterator[tuple]:
    p = tomllib.loads(text).get("project", {})
    if p:
        yield "package", p.get("name"), p.get("version"), None
    groups = [("runtime", p.get("dependencies", [])), *((f"extra:{k}", v) for k, v in p.get("optional-dependencies", {}).items())]
    for scope, wants in groups:
        for want in wants:
            m = re.match(r"\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*([^;]*)", want)
            yield "dependency", re.sub(r"[-_.]+", "-", m[1]).lower(), m[2].strip() or None, scope


def pom_xml(text: str) -> Iterator[tuple]:
    root = ET.fromstring(text)
    plain = lambda e: e.tag.rpartition("}")[2]
    child = lambda e, n: next((c for c in e if plain(c) == n), None)
    value = lambda e, n: (child(e, n).text or "").strip() if e is not None and child(e, n) is not None else None
    group = value(root, "groupId") or value(child(root, "parent"), "groupId")
    yield "package", f"{group}:{value(root, 'artifactId')}", value(root, "version") or value(child(root, "parent"), "version"), None
    for d in child(root, "dependencies") if child(root, "dependencies") is not None else ():
        scope = "optional" if value(d, "optional") == "true" else value(d, "scope") or "compile"
        yield "dependency", f"{value(d, 'groupId')}:{value(d, 'artifactId')}", value(d, "version"), scope


def markdown(text: str) -> Iterator[tuple]:
    """Headings as sections under their parent heading, and links."""
    stack: list[tuple[int, str]] = []
    fence = None
    for line in text.split("\n"):
        if m := re.match(r"\s{0,3}(```+|~~~+)", line):
            fence = None if fence == m[1][0] else fence or m[1][0]
            continue
        if fence:
            continue
        if m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            yield "section", m[2], str(len(m[1])), stack[-1][1] if stack else None
            stack.append((len(m[1]), m[2]))
        for label, target in re.findall(r"(?<!!)\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)", line):
            yield "link", target, label, stack[-1][1] if stack else None


PARSERS: dict[str, Callable[[str], Iterator[tuple]]] = {"go.mod": go_mod, "go.work": go_mod, "package.json": package_json, "cargo.toml": cargo_toml, "pyproject.toml": pyproject_toml, "pom.xml": pom_xml}


def facts_of(path: str, text: str | None) -> list[tuple]:
    """Rows of FACT for one file; a file that no parser knows has none."""
    base = path.rpartition("/")[2].lower()
    parser = PARSERS.get(base) or (markdown if base.endswith((".md", ".markdown")) else None)
    if parser is None:
        return []
    try:
        return [(path, *fact, None) for fact in parser(text or "")]
    except Exception as e:  # a malformed file is a row of its own, whatever its parser met
        return [(path, "failed", None, None, None, f"{type(e).__name__}: {e}"[:500])]


def manifest_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, text)."""
    names = [c.split()[0] for c in FACT.split(", ")]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([f for p, t in zip(pdf["path"], pdf["text"]) for f in facts_of(p, t)], columns=names)

    return files.select("path", "text").mapInPandas(read, FACT)
