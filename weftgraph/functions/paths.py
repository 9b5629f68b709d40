"""Path arithmetic on columns. Paths compare by component, so sort keys are arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parts(path) -> Column:
    return F.split(_c(path), "/")


def dirname(path) -> Column:
    """All but the last component; empty for a bare file name."""
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def stem(path) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def joined(folder, name) -> Column:
    return F.when(_c(folder) == "", _c(name)).otherwise(F.concat(_c(folder), F.lit("/"), _c(name)))


def source_root(path) -> Column:
    """The path up to its first ``src``, null without one."""
    at = F.array_position(parts(path), "src").cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts(path), 1, at), "/"))


def module_segments(path) -> Column:
    """Components below the first ``src``, with the stem last unless the file is mod.rs or lib.rs; [] without ``src``."""
    p = parts(path)
    at = F.array_position(p, "src").cast("int")
    below = F.slice(p, at + 1, F.greatest(F.lit(0), F.size(p) - at - 1))
    own = F.when(basename(path).isin("mod.rs", "lib.rs"), F.array().cast("array<string>")).otherwise(F.array(stem(path)))
    return F.when(at > 0, F.concat(below, own)).otherwise(F.array().cast("array<string>"))


def import_segments(path) -> Column:
    return F.filter(F.split(_c(path), "::"), lambda s: s != "")
