"""Source trees: discovery of .rs files under ignore rules on the driver, contents read by Spark's own reader.

Ignore rules go from folder to folder, so the tree is listed by the driver (a path, a time and a length per file, as Spark
does for any input). The root must be a folder that driver and executors share."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FILES
from .shared import exactly

IGNORE_FILES = (".gitignore", ".ignore")
LISTING = "path string, mtime bigint, len bigint"
NOT_UTF8 = "Invalid UTF-8 in file "


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return out


class Rules:
    """The patterns of one ignore file; the last that matches decides."""

    def __init__(self, folder: str, text: str):
        self.folder, self.rules = folder, []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated or line.startswith("\\#") or line.startswith("\\!") else line
            folders_only, anchored = line.endswith("/"), "/" in line.rstrip("/")
            body = _regex(line.strip("/"))
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z"), folders_only, negated))

    def decide(self, path: str, is_folder: bool) -> bool | None:
        """True: ignored, False: taken back, None: no pattern matches."""
        rest = os.path.relpath(path, self.folder).replace(os.sep, "/")
        for pattern, folders_only, negated in reversed(self.rules):
            if (is_folder or not folders_only) and pattern.match(rest):
                return not negated
        return None


def _rules_in(folder: str) -> list[Rules]:
    out = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out.append(Rules(folder, f.read()))
        except OSError:
            continue
    return out


def discover(root: str, ignore_rules: bool = True) -> list[tuple[str, int, int]]:
    """(path, mtime in seconds, length) of regular .rs files, hidden ones left out, in path order. Rules of deeper folders
    win over those of their parents, those of .ignore over .gitignore."""
    found = []

    def ignored(path: str, is_folder: bool, rules: list[Rules]) -> bool:
        for r in reversed(rules):
            if (verdict := r.decide(path, is_folder)) is not None:
                return verdict
        return False

    above: list[Rules] = []
    if ignore_rules:
        parents, at = [], os.path.abspath(root)
        while (up := os.path.dirname(at)) != at:
            parents.append(up)
            at = up
        for p in reversed(parents):
            above += _rules_in(p)
    stack = [(root, above)]
    while stack:
        folder, rules = stack.pop()
        if ignore_rules:
            rules = rules + _rules_in(folder)
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    e.name.encode("utf-8")
                except UnicodeEncodeError:
                    continue
                is_folder = e.is_dir(follow_symlinks=False)
                if e.name.startswith(".") or ignore_rules and ignored(os.path.abspath(e.path), is_folder, [_absolute(r) for r in rules]):
                    continue
                if is_folder:
                    stack.append((e.path, rules))
                elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1] == ".rs":
                    s = e.stat()
                    found.append((e.path, int(s.st_mtime), s.st_size))
    return sorted(found, key=lambda x: x[0].split("/"))


def _absolute(rules: Rules) -> Rules:
    rules.folder = os.path.abspath(rules.folder)
    return rules


def read(spark: SparkSession, listing: list[tuple[str, int, int]]) -> DataFrame:
    """files(path, content, mtime, len) of a listing, read by Spark. A file that can't be read, or isn't UTF-8, fails the
    job that reads it."""
    if not listing:
        return spark.createDataFrame([], FILES)
    names = spark.createDataFrame([(os.path.abspath(p), p, t, n) for p, t, n in listing], f"place string, {LISTING}")
    places = [exactly("file://" + os.path.abspath(p)) for p, _, _ in listing]
    found = spark.read.format("binaryFile").load(places).select(F.regexp_replace("path", "^file:/+", "/").alias("place"), F.col("content").cast("string").alias("content"))
    text = F.when(F.is_valid_utf8("content"), F.col("content")).when(F.col("content").isNull() & (F.col("len") == 0), "")  # empty files have no row
    text = text.otherwise(F.raise_error(F.concat(F.when(F.col("content").isNull(), "Can't read file ").otherwise(NOT_UTF8), F.col("place"))))
    return names.join(found, "place", "left").select("path", text.alias("content"), "mtime", "len")


def scan(spark: SparkSession, root: str, ignore_rules: bool = True) -> DataFrame:
    return read(spark, discover(root, ignore_rules))


def project_root(start: str = ".") -> str:
    """The nearest folder upwards with a Cargo.toml and a src folder, else the start."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(at, "Cargo.toml")) and os.path.isdir(os.path.join(at, "src")):
            return at
        if (up := os.path.dirname(at)) == at:
            return os.path.abspath(start)
        at = up
