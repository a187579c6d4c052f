"""Package manifests as modules and dependencies.

Each manifest is a row of (path, text); JSON and TOML are parsed by an Arrow
batch function, one call a batch. Workspaces, which need other manifests, are
joins on folders afterwards.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.paths import parent

NAMES = ("package.json", "pyproject.toml", "requirements.txt", "setup.py", "go.mod", "Cargo.toml", "CMakeLists.txt")
DEPENDS, DEV, EXPORTS, IMPORTS = "MODULE_DEPENDS_ON", "DEV_DEPENDS_ON", "EXPORTS_TO", "IMPORTS_FROM"
_EDGE = "struct<source:string,target:string,kind:string,version:string,is_optional:boolean,is_dev:boolean>"
SCHEMA = f"path string, dir string, id string, name string, type string, language string, version string, description string, members array<string>, edges array<{_EDGE}>"


def is_manifest(path):
    """Manifests but for those of installed packages and build folders."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    left_out = (base.isin("package.json", "setup.py") & path.contains("node_modules")) | ((base == "Cargo.toml") & path.contains("target")) | ((base == "CMakeLists.txt") & path.contains("build"))
    return base.isin(*NAMES) & ~left_out


def _edge(source: str, target: str, kind: str = DEPENDS, version: object = None, optional: bool = False) -> dict:
    return {"source": source, "target": target, "kind": kind, "version": None if version is None else str(version), "is_optional": bool(optional), "is_dev": kind == DEV}


def _first(pattern: str, text: str, flags: int = 0) -> str | None:
    m = re.search(pattern, text, flags)
    return m[1] if m else None


def _node(lang: str, name: str, kind: str, language: str, **rest) -> dict:
    return {"id": f"{lang}:{name}", "name": name, "type": kind, "language": language, "version": None, "description": None, "members": [], "edges": []} | rest


def _npm(text: str, folder: str) -> dict:
    data = json.loads(text)
    spaces = data.get("workspaces")
    members = spaces.get("packages", []) if isinstance(spaces, dict) else spaces or []
    node = _node("js", data.get("name", folder), "package" if spaces is None else "workspace", "javascript", version=data.get("version"), description=data.get("description"), members=list(members))
    for part, kind in (("dependencies", DEPENDS), ("devDependencies", DEV), ("peerDependencies", DEPENDS)):
        node["edges"] += [_edge(node["id"], f"js:{d}", kind, v) for d, v in data.get(part, {}).items()]
    return node


def _pyproject(text: str, folder: str) -> dict:
    data = tomllib.loads(text)
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    node = _node("py", poetry.get("name") or project.get("name") or folder, "package", "python", version=poetry.get("version") or project.get("version"), description=project.get("description"))

    def plain(dep: str) -> str:
        return dep.split(";")[0].strip() if ";" in dep else dep

    for dep in map(plain, project.get("dependencies", []) if isinstance(project.get("dependencies", []), list) else []):
        m = re.match(r"([\w-]+)\s*(.*)$", dep, re.ASCII) if set(dep) & set("<>=!") else None
        node["edges"].append(_edge(node["id"], f"py:{m[1] if m else dep}", version=m[2].strip() if m else None))
    node["edges"] += [_edge(node["id"], f"py:{d}", version=None if isinstance(v, dict) else v) for d, v in poetry.get("dependencies", {}).items() if d != "python"]
    node["edges"] += [_edge(node["id"], f"py:{plain(d)}", DEV) for group in project.get("optional-dependencies", {}).values() for d in group]
    return node


def _requirements(text: str, folder: str) -> dict:
    node = _node("py:req", folder, "requirements", "python")
    for line in map(str.strip, text.splitlines()):
        if line[:1] not in ("", "#", "-") and (m := re.fullmatch(r"([\w.-]+)\s*([<>=!~]+.+)?", line, re.ASCII)):
            node["edges"].append(_edge(node["id"], f"py:{m[1]}", version=m[2] and m[2].strip()))
    return node


def _setup_py(text: str, folder: str) -> dict:
    quoted = r"""\s*=\s*["']([^"']+)["']"""
    node = _node("py", _first("name" + quoted, text) or folder, "package", "python", version=_first("version" + quoted, text))
    listed = _first(r"install_requires\s*=\s*\[([^\]]+)\]", text) or ""
    node["edges"] = [_edge(node["id"], f"py:{m[1]}", version=m[2]) for m in re.finditer(r"""["']([\w.-]+)([<>=!~][^"']*)?["']""", listed, re.ASCII)]
    return node


def _go(text: str, folder: str) -> dict | None:
    name = _first(r"^module\s+(\S+)", text, re.M)
    if name is None:
        return None
    node = _node("go", name, "module", "go")
    for block in re.findall(r"require\s*\((.*?)\)", text, re.S):
        for line in map(str.strip, block.splitlines()):
            parts = line.split()
            if len(parts) >= 2 and not line.startswith("//"):
                node["edges"].append(_edge(node["id"], f"go:{parts[0]}", version=parts[1], optional="// indirect" in line))
    node["edges"] += [_edge(node["id"], f"go:{d}", version=v) for d, v in re.findall(r"^require\s+([^\s(]\S*)\s+(\S+)", text, re.M)]
    return node


def _cargo(text: str, folder: str) -> dict | None:
    data = tomllib.loads(text)
    package, space = data.get("package", {}), data.get("workspace", {})
    node = _node("rs", package.get("name") or folder, "workspace" if space else "crate", "rust", version=package.get("version"), description=package.get("description"), members=list(space.get("members", [])))

    def add(deps: dict, kind: str = DEPENDS, with_optional: bool = False) -> None:
        for d, spec in deps.items():
            table = spec if isinstance(spec, dict) else {"version": spec}
            node["edges"].append(_edge(node["id"], f"rs:{d}", kind, table.get("version"), with_optional and table.get("optional", False)))

    add(space.get("dependencies", {}))
    add(data.get("dependencies", {}), with_optional=True)
    add(data.get("dev-dependencies", {}), DEV)
    return node


def _cmake(text: str, folder: str) -> dict:
    word = r"([\w-]+)"
    node = _node("cpp", _first(rf"project\s*\(\s*{word}", text, re.I | re.A) or folder, "project", "cpp")
    targets = re.findall(rf"add_(?:executable|library)\s*\(\s*{word}", text, re.I | re.A)
    node["edges"] = [_edge(node["id"], f"cpp:{t}", EXPORTS) for t in targets if t != node["name"]]
    scopes = {"PUBLIC", "PRIVATE", "INTERFACE"}
    for target, libs in re.findall(rf"target_link_libraries\s*\(\s*{word}\s+(.*?)\)", text, re.I | re.S | re.A):
        node["edges"] += [_edge(f"cpp:{target}", f"cpp:{x}") for x in libs.split() if x not in scopes]
    return node


_READERS = {"package.json": _npm, "pyproject.toml": _pyproject, "requirements.txt": _requirements, "setup.py": _setup_py, "go.mod": _go, "Cargo.toml": _cargo, "CMakeLists.txt": _cmake}


def read_manifest(path: str, text: str) -> dict | None:
    """The module of one manifest with its edges and workspace patterns; None if it can't be read."""
    folder, _, base = path.rpartition("/")
    try:
        node = _READERS[base](text, folder.rpartition("/")[2])
    except (ValueError, AttributeError, TypeError):
        return None
    return node and {"path": path, "dir": folder} | node


def parse_manifests(files: DataFrame) -> DataFrame:
    """SCHEMA rows of the manifests among files(path, text); broken ones are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [m for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None and (m := read_manifest(p, t))]
            if rows:
                yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in schema} for r in rows], schema=schema)

    return files.where(is_manifest(F.col("path"))).select("path", "text").mapInArrow(run, SCHEMA)


def module_edges(manifests: DataFrame) -> DataFrame:
    """(source, target, kind, version, is_optional, is_dev) of all manifests.

    A workspace also has an edge to and from each member, and lists its
    members' edges again: rows aren't merged.
    """
    own = manifests.select("id", F.explode("edges").alias("e")).select("e.*")
    space = manifests.select("id", "language", "dir", F.explode("members").alias("pattern"))
    base = F.regexp_replace(F.element_at(F.split("pattern", r"\*"), 1), "/+$", "")
    at = F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), F.nullif(base, F.lit("")))
    space = space.select("id", "language", F.col("pattern").contains("*").alias("any"), at.alias("home"))
    member = manifests.where(F.col("path").rlike(r"(?:package\.json|Cargo\.toml)$")).select(F.col("id").alias("member"), "language", "dir", F.col("edges").alias("member_edges"))
    direct = space.where(~F.col("any")).join(member.withColumnRenamed("dir", "home"), ["language", "home"])
    below = space.where("any").join(member.withColumn("home", parent(F.col("dir"))).drop("dir"), ["language", "home"])
    joined = direct.select("id", "member", "member_edges").unionAll(below.select("id", "member", "member_edges"))

    def link(a: str, b: str, kind: str):
        no = F.lit(False)
        return F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("version"), no.alias("is_optional"), no.alias("is_dev"))

    both = F.array(link("id", "member", EXPORTS), link("member", "id", IMPORTS))
    return own.unionAll(joined.select(F.explode(F.concat(both.cast(f"array<{_EDGE}>"), "member_edges")).alias("e")).select("e.*"))
