"""Ignore rules as column expressions over paths."""

from __future__ import annotations

import re
from functools import cached_property, reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An expression for shell globs: * also crosses slashes, ? is one character, [...] a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c) if not c.isalnum() and c not in "_/ " else c
        i += 1
    return out


class Rule:
    """One line of an ignore file: ! keeps, a last slash means folders only, a first one the root only."""

    def __init__(self, line: str):
        text = line.strip()
        self.keeps = text.startswith("!")
        text = text[1:] if self.keeps else text
        self.folders_only = text.endswith("/")
        text = text[:-1] if self.folders_only else text
        self.at_root = text.startswith("/")
        self.glob = text[1:] if self.at_root else text

    def matches(self, path: Column, is_dir: bool) -> Column:
        if self.folders_only and not is_dir:
            return F.lit(False)
        if self.at_root:
            return (path == self.glob) | path.startswith(self.glob + "/")
        # the whole path, any component, or anything after a slash
        body = glob_regex(self.glob)
        return path.rlike(rf"(?s)^(?:{body})$") | F.exists(F.split(path, "/"), lambda part: part.rlike(rf"(?s)^(?:{body})$")) | path.rlike(rf"(?s)^.*/(?:{body})$")


    def covers(self, path: str, is_dir: bool) -> bool:
        """matches() for one path."""
        if self.folders_only and not is_dir:
            return False
        if self.at_root:
            return path == self.glob or path.startswith(self.glob + "/")
        return any(self._whole.match(p) for p in (path, *path.split("/"))) or self._below.match(path) is not None

    @cached_property
    def _whole(self) -> re.Pattern:
        return re.compile(rf"(?s)^(?:{glob_regex(self.glob)})\Z")

    @cached_property
    def _below(self) -> re.Pattern:
        return re.compile(rf"(?s)^.*/(?:{glob_regex(self.glob)})\Z")


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules of the lines of an ignore file; empty lines and comments are left out."""
    return [Rule(x) for x in lines if x.strip() and not x.strip().startswith("#")]


def rule_stats(rules: list[Rule]) -> dict[str, int]:
    """How many rules there are, and of which form."""
    return {"rules": len(rules), "keeps": sum(r.keeps for r in rules), "folders_only": sum(r.folders_only for r in rules), "at_root": sum(r.at_root for r in rules)}


def ignored_path(path: str, rules: list[Rule], include: list[Rule] = (), exclude: list[Rule] = (), is_dir: bool = False) -> bool:
    """ignored() for one path, for a walk that leaves folders out as it goes."""
    if any(r.covers(path, is_dir) for r in include):
        return False
    if any(r.covers(path, is_dir) for r in exclude) or (base := path.rpartition("/")[2]).startswith(".") and base not in (".", ".."):
        return True
    return next((not r.keeps for r in reversed(rules) if r.covers(path, is_dir)), False)


def load_rules(*sources: str | Path | list[str]) -> list[Rule]:
    """Rules of files and lists in order; empty lines and comments are left out, missing files are skipped."""
    out = []
    for s in sources:
        lines = s if isinstance(s, list) else Path(s).read_text().splitlines() if Path(s).exists() else []
        out += parse_rules(lines)
    return out


def ignored(path: Column, rules: list[Rule], include: list[Rule] = (), exclude: list[Rule] = (), is_dir: bool = False) -> Column:
    """Included paths are kept, excluded and hidden ones dropped; then the last rule that matches decides."""
    verdict: Column = F.lit(False)
    for r in rules:
        verdict = F.when(r.matches(path, is_dir), F.lit(not r.keeps)).otherwise(verdict)
    hidden = F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"^\.(?!\.?$)")
    some = lambda rs: reduce(lambda a, b: a | b, [r.matches(path, is_dir) for r in rs], F.lit(False))
    return F.when(some(include), False).when(some(exclude), True).when(hidden, True).otherwise(verdict)


def ignored_with_parents(path: Column, rules: list[Rule], include: list[Rule] = (), exclude: list[Rule] = ()) -> Column:
    """Also dropped if any folder above is: a walk never enters it, so no include below it applies."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    return F.exists(above, lambda d: ignored(d, rules, include, exclude, True)) | ignored(path, rules, include, exclude, False)
