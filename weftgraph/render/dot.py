"""DOT text of a graph, a line per row; only the writer of a whole document collects."""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RenderError
from ..functions import paths
from ..model import CodeGraph

# Fixed values of the output format: colours by kind and theme, shapes, labels and styles of edges.
COLOURS = {
    "light": {"Module": "#e3f2fd", "Function": "#e8f5e9", "Struct": "#fff3e0", "Enum": "#f3e5f5", "Trait": "#ede7f6", "Impl": "#fce4ec", "Const": "#f1f8e9", "Static": "#f9fbe7", "Type": "#e0f7fa", "Macro": "#fffde7"},
    "dark": {"Module": "#0d47a1", "Function": "#1b5e20", "Struct": "#e65100", "Enum": "#4a148c", "Trait": "#311b92", "Impl": "#880e4f", "Const": "#33691e", "Static": "#827717", "Type": "#006064", "Macro": "#f57f17"},
}
SHAPES = {"Module": "folder", "Function": "ellipse", "Struct": "box", "Enum": "hexagon"}
EDGES = {"Uses": ("uses:", "#1e88e5", "solid"), "Implements": ("impl:", "#8e24aa", "dashed"), "Contains": ("contains:", "#9e9e9e", "dotted"), "Extends": ("extends:", "#fb8c00", "dashed"), "Calls": ("calls:", "#e53935", "solid")}


def _pick(column: str, table: dict, default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _text(x: Column) -> Column:
    return F.replace(x, F.lit('"'), F.lit('\\"'))


def sanitised(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "_")


def node_lines(items: DataFrame, theme: str = "light", indent: str = "  ") -> DataFrame:
    """items with ``line``."""
    label = F.concat(F.col("kind"), F.lit(" "), _text(F.col("name")))
    line = F.concat(F.lit(indent + '"'), "item_id", F.lit('" [label="'), label, F.lit('", fillcolor="'), _pick("kind", COLOURS[theme], "#ffffff"), F.lit('", shape="'), _pick("kind", SHAPES, "box"), F.lit('", URL="item://'), "item_id", F.lit('", tooltip="'), _text(F.concat_ws(" ", "path", F.col("line_start").cast("string"))), F.lit('"];'))
    return items.withColumn("line", line)


def width(strength: Column) -> Column:
    """Clamped to 0.8 to 3, whole numbers without a fraction."""
    w = F.least(F.lit(3.0), F.greatest(F.lit(0.8), strength))
    return F.when(w == F.floor(w), w.cast("int").cast("string")).otherwise(w.cast("string"))


def edge_lines(relationships: DataFrame) -> DataFrame:
    """relationships with ``label`` and ``line``."""
    label = F.concat(_pick("rel_type", {k: v[0] for k, v in EDGES.items()}, ""), F.col("rel_detail"))
    line = F.concat(F.lit('  "'), "from_item", F.lit('" -> "'), "to_item", F.lit('" [label="'), _text(label), F.lit('", color="'), _pick("rel_type", {k: v[1] for k, v in EDGES.items()}, "#000000"), F.lit('", style="'), _pick("rel_type", {k: v[2] for k, v in EDGES.items()}, "solid"), F.lit('", penwidth='), width(F.col("strength")), F.lit("];"))
    return relationships.withColumn("label", label).withColumn("line", line)


def document(graph: CodeGraph, theme: str = "light", rankdir: str = "LR", splines: str = "curved", clusters: bool = False, legend: bool = True, rounded: bool = True) -> str:
    """The whole document; for graphs that fit the driver."""
    items = node_lines(graph.items, theme, "    " if clusters else "  ").orderBy(paths.parts("path"), "ordinal").select("path", "line").collect()
    edges = [r["line"] for r in edge_lines(graph.relationships).orderBy("from_item", "rel_type", "to_item", "context").select("line").collect()]
    style = "filled,rounded" if rounded else "filled"
    out = ["digraph weftgraph", "{", f"  rankdir={rankdir};", f"  graph [fontname=Helvetica, splines={splines}] ;", f'  node [shape=box, fontsize=10, style="{style}"] ;', "  edge [fontsize=8] ;"]
    if clusters:
        from ..operators.relate import module_parents

        parent = {r["path"]: r["parent"] for r in module_parents(graph.files).collect()}
        below: dict = {}
        lines: dict = {}
        for r in items:
            lines.setdefault(r["path"], []).append(r["line"])
        for p in sorted(lines, key=lambda p: p.split("/")):
            below.setdefault(parent.get(p), []).append(p)
        stack, seen = [(p, False) for p in reversed(below.get(None, []))], set()
        while stack:
            p, done = stack.pop()
            if done:
                out.append("  }")
            elif p not in seen:
                seen.add(p)
                name = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in p)
                out += [f'  subgraph "cluster_{name}" {{', f'    label="{p.rsplit("/", 1)[-1]}";', "    color=lightgrey;", *lines[p]]
                stack.append((p, True))
                stack += [(c, False) for c in reversed(below.get(p, []))]
    else:
        out += [r["line"] for r in items]
    out += edges
    if legend:
        out += ["  subgraph cluster_legend {", '    label="Legend";', *[f'    "legend_{k}" [label="{k}", fillcolor="{COLOURS[theme][k]}"];' for k in list(COLOURS[theme])[:5]], "  }"]
    return "\n".join([*out, "}"]) + "\n"


def with_interaction(svg: str) -> str:
    """Style and script before the last closing tag, or at the end."""
    extra = "<style>.node:hover{opacity:.7;cursor:pointer}</style><script><![CDATA[document.querySelectorAll('.node').forEach(n=>n.addEventListener('click',()=>n.classList.toggle('selected')));]]></script>"
    at = svg.rfind("</svg>")
    return svg + extra if at < 0 else svg[:at] + extra + svg[at:]


def svg(text: str, interactive: bool = True) -> str:
    """DOT text to SVG by Graphviz; RenderError if it isn't there or fails."""
    tool = shutil.which("dot")
    if tool is None:
        raise RenderError("Graphviz (dot) is not installed")
    done = subprocess.run([tool, "-Tsvg"], input=text.encode(), capture_output=True)
    if done.returncode:
        raise RenderError(f"dot failed: {done.stderr.decode(errors='replace')}")
    return with_interaction(done.stdout.decode()) if interactive else done.stdout.decode()
