"""What a path is: by its base name, then by rules, then by its extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import last_segment

# Formats and node kinds by exact base name, by extension and by pattern. "" is no format of its own, and a
# kind of "file" means no node besides the file's.
BASENAMES = {
    "go.mod": ("gomod", "file"),
    "go.work": ("gowork", "file"),
    "package.json": ("packagejson", "file"),
    "Cargo.toml": ("cargo", "file"),
    "pyproject.toml": ("pyproject", "file"),
    "pom.xml": ("pom", "file"),
    "Dockerfile": ("dockerfile", "build_target"),
    "Jenkinsfile": ("jenkins", "configuration"),
    ".gitlab-ci.yml": ("gitlab-ci", "configuration"),
    ".travis.yml": ("travis", "configuration"),
    "azure-pipelines.yml": ("azure-pipelines", "configuration"),
    "bitbucket-pipelines.yml": ("bitbucket-pipelines", "configuration"),
    "kustomization.yaml": ("kustomize", "configuration"),
    "kustomization.yml": ("kustomize", "configuration"),
    "Chart.yaml": ("helm", "configuration"),
    "build.gradle": ("gradle", "build_target"),
    "build.gradle.kts": ("gradle", "build_target"),
    "settings.gradle": ("gradle", "build_target"),
    "settings.gradle.kts": ("gradle", "build_target"),
    "BUILD": ("bazel", "build_target"),
    "BUILD.bazel": ("bazel", "build_target"),
    "WORKSPACE": ("bazel", "build_target"),
    "WORKSPACE.bazel": ("bazel", "build_target"),
    "MODULE.bazel": ("bazel", "build_target"),
    "CMakeLists.txt": ("cmake", "build_target"),
    "Makefile": ("make", "build_target"),
    "makefile": ("make", "build_target"),
    "GNUmakefile": ("make", "build_target"),
}
EXTENSIONS = {
    "md": ("markdown", "document"),
    "markdown": ("markdown", "document"),
    "rst": ("rst", "document"),
    "adoc": ("asciidoc", "document"),
    "asciidoc": ("asciidoc", "document"),
    "txt": ("text", "document"),
    "graphql": ("graphql", "document"),
    "gql": ("graphql", "document"),
    "graphqls": ("graphql", "document"),
    "proto": ("protobuf", "document"),
    "sql": ("sql", "document"),
    "tf": ("terraform", "configuration"),
    "tfvars": ("terraform", "configuration"),
    "bzl": ("bazel", "build_target"),
    "cmake": ("cmake", "build_target"),
    "mk": ("make", "build_target"),
    "dockerfile": ("dockerfile", "build_target"),
}
LANGUAGES = {
    "py": "python",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "c": "c",
    "h": "c",
    "cc": "cpp",
    "cpp": "cpp",
    "js": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
}


def _lookup(key: Column, table: dict[str, tuple[str, ...]], field: int) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v[field]) if out is None else out.when(key == k, v[field])
    return out


def classify(path: Column) -> tuple[Column, Column]:
    """(format, kind) of a path below the root. Base names are exact; extensions and documents' names go by lower case."""
    base, lower = last_segment(path), F.lower(last_segment(path))
    ext = F.when(lower.contains("."), F.substring_index(lower, ".", -1))
    yaml = lower.rlike(r"\.ya?ml$")
    named = [
        (base.startswith("Dockerfile."), "dockerfile", "build_target"),
        (path.rlike(r"^\.github/workflows/[^/]+$") & yaml, "github-actions", "configuration"),
        (path == ".circleci/config.yml", "circleci", "configuration"),
        (lower.rlike(r"^(compose|docker-compose.*)\.ya?ml$"), "compose", "configuration"),
        (lower.rlike(r"^(openapi|swagger)(\..*)?\.(ya?ml|json)$"), "openapi", "document"),
        (ext.isin("md", "markdown") & path.rlike(r"(?i)(^|/)adrs?/([^/]*/)*[^/]*$"), "adr", "document"),
    ]
    prose = lower.rlike(r"^(readme|changelog|contributing|license|notice|authors)")
    out = []
    for field, none in ((0, ""), (1, "file")):
        by_rule = F.lit(None).cast("string")
        for rule in reversed(named):
            by_rule = F.when(rule[0], rule[1 + field]).otherwise(by_rule)
        out.append(F.coalesce(_lookup(base, BASENAMES, field), by_rule, _lookup(ext, EXTENSIONS, field), F.when(prose, ("text", "document")[field]), F.lit(none)))
    return out[0], out[1]


def language(path: Column, c_units: int, cpp_units: int) -> Column:
    """The language of a source file by its extension; a header is C++ where the snapshot has more C++ units than C ones."""
    base = F.lower(last_segment(path))
    ext = F.when(base.contains("."), F.substring_index(base, ".", -1))
    code = LANGUAGES | {"h": "cpp" if cpp_units > c_units else "c"}
    return _lookup(ext, {k: (v,) for k, v in code.items()}, 0)
