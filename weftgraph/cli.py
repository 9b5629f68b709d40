"""python -m weftgraph.cli build|query|completions: builds a graph of a source tree, asks one of the graph queries, or
writes a shell's completions. Flags come before the environment, that before the settings of --config."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ParseError, QueryError, WeftError
from .functions import paths
from .model import CodeGraph
from .operators import queries, traverse
from .plans.build import build_tree
from .render import dot, table
from .sources import config, document, store, tree
from .sources.cache import CacheMode

ON_OFF = {"on": True, "off": False}
SHELLS = {
    "bash": 'complete -W "{words}" weftgraph\n',
    "zsh": "#compdef weftgraph\ncompadd -- {words}\n",
    "fish": 'complete -c weftgraph -a "{words}"\n',
    "elvish": "set edit:completion:arg-completer[weftgraph] = {{|@words| put {words} }}\n",
    "powershell": "Register-ArgumentCompleter -Native -CommandName weftgraph -ScriptBlock {{ param($word) '{words}'.Split(' ') | Where-Object {{ $_ -like \"$word*\" }} }}\n",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph")
    top.add_argument("-v", "--verbose", action="count", default=0)
    top.add_argument("-q", "--quiet", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-p", "--path", default=os.environ.get("WEFTGRAPH_PATH"))
    common.add_argument("-c", "--config")
    common.add_argument("-I", "--no-ignore", "--no-gitignore", "--all", "--ni", action="store_true", default=os.environ.get("WEFTGRAPH_NO_IGNORE", "").lower() in ("1", "true"))
    common.add_argument("--graph", default=os.environ.get("WEFTGRAPH_GRAPH"), help="a saved graph (a folder, or a .json document) instead of a path")
    b = commands.add_parser("build", parents=[common])
    b.add_argument("--save")
    b.add_argument("--dot")
    b.add_argument("--svg")
    b.add_argument("--json")
    for name, choices in (("clusters", ON_OFF), ("legend", ON_OFF), ("theme", ["light", "dark"]), ("rankdir", ["LR", "TB"]), ("splines", ["curved", "ortho", "polyline"]), ("rounded", ON_OFF)):
        b.add_argument(f"--dot-{name}", choices=list(choices))
    b.add_argument("--svg-interactive", choices=list(ON_OFF))
    b.add_argument("--no-cache", action="store_true", help="parse all files; the cache is written anew")
    b.add_argument("--rebuild", action="store_true", help="clear the cache, then parse all files")
    commands.add_parser("completions").add_argument("shell", choices=list(SHELLS))
    asked = commands.add_parser("query").add_subparsers(dest="query", required=True)
    common.add_argument("-f", "--format", choices=["text", "json"], default=os.environ.get("WEFTGRAPH_FORMAT"))
    common.add_argument("--offset", type=int, default=0)
    common.add_argument("--limit", type=int)
    asked.add_parser("connected-files", parents=[common]).add_argument("file")
    q = asked.add_parser("function-usage", parents=[common])
    q.add_argument("function")
    q.add_argument("--direction", choices=["callers", "callees"], default="callers")
    asked.add_parser("cycles", parents=[common])
    q = asked.add_parser("path", parents=[common])
    q.add_argument("source")
    q.add_argument("target")
    for name in ("hubs", "module-centrality"):
        q = asked.add_parser(name, parents=[common])
        q.add_argument("--metric", choices=["in", "out", "total"], default="total")
        q.add_argument("--top", type=int, default=10)
    asked.add_parser("trait-impls", parents=[common]).add_argument("trait_name")
    q = asked.add_parser("unreferenced-items", parents=[common])
    q.add_argument("--include-public", action="store_true")
    q.add_argument("--exclude")
    q = asked.add_parser("item-info", parents=[common])
    q.add_argument("--item-id")
    q.add_argument("--name")
    q.add_argument("--kind")
    q.add_argument("--show-code", action="store_true")
    return top


def _answer(g: CodeGraph, a) -> tuple[DataFrame, list]:
    """(rows, order)."""
    degree = {"in": F.col("indegree"), "out": F.col("outdegree"), "total": F.col("indegree") + F.col("outdegree")}
    if a.query == "connected-files":
        return queries.connected_files(g, a.file), [paths.parts("path")]
    if a.query == "function-usage":
        return queries.function_usage(g, a.function, a.direction), [paths.parts("path")]
    if a.query == "cycles":
        return traverse.cycles(g), ["cycle"]
    if a.query == "path":
        return traverse.shortest_path(g, a.source, a.target), ["step"]
    if a.query == "hubs":
        return queries.hubs(g, a.metric, a.top), [degree[a.metric].desc(), paths.parts("path")]
    if a.query == "module-centrality":
        return queries.module_centrality(g, a.metric, a.top), [degree[a.metric].desc(), paths.parts("module")]
    if a.query == "trait-impls":
        return queries.trait_impls(g, a.trait_name), [paths.parts("path"), "type"]
    return queries.unreferenced_items(g, a.include_public, a.exclude), [paths.parts("path"), "id"]


def _as_json(query: str, rows: list):
    """Paths as bare strings, cycles as lists of paths, all else as objects."""
    if query in ("connected-files", "function-usage", "path"):
        return [r["path"] for r in rows]
    if query == "cycles":
        return [r["files"].split(" -> ") for r in rows]
    return [r.asDict() for r in rows]


def _as_text(query: str, rows: list, a) -> str:
    """The text form: lines or a grid, whose row numbers go on from the offset; more columns with -v."""
    numbers = range(a.offset + 1, a.offset + len(rows) + 1)
    if query == "connected-files":
        return table.grid(["#", "Path"], [[n, r["path"]] for n, r in zip(numbers, rows)])
    if query in ("function-usage", "cycles"):
        return "\n".join(r["path" if query == "function-usage" else "files"] for r in rows)
    if query == "path":
        return table.grid(["Step", "Path"], [[n, r["path"]] for n, r in zip(numbers, rows)]) if rows else "<no path>"
    if query in ("hubs", "module-centrality"):
        name, total = rows[0].__fields__[0] if rows else "path", lambda r: r["indegree"] + r["outdegree"]
        title = "Path" if query == "hubs" else "Module"
        if a.verbose:
            return table.grid([title, "In", "Out", "Total"], [[r[name], r["indegree"], r["outdegree"], total(r)] for r in rows])
        return table.grid([title, "Total"], [[r[name], total(r)] for r in rows])
    if query == "trait-impls":
        columns = {"Path": "path"} | ({"Type": "type"} if a.verbose else {})
        return table.grid(list(columns), [[r[c] for c in columns.values()] for r in rows]) if rows else "<no implementations found>"
    columns = {"Path": "path", "ItemId": "id", "Name": "name", "Kind": "kind", "Vis": "visibility"} if a.verbose else {"Path": "path", "Name": "name"}
    return table.grid(list(columns), [[r[c] for c in columns.values()] for r in rows]) if rows else "<no unreferenced items>"


def _completions(top: argparse.ArgumentParser, shell: str) -> str:
    def words(p: argparse.ArgumentParser):
        for action in p._actions:
            yield from action.option_strings
            if isinstance(action, argparse._SubParsersAction):
                for name, below in action.choices.items():
                    yield name
                    yield from words(below)

    return SHELLS[shell].format(words=" ".join(sorted(set(words(top)))))


def _drawing(a, settings: dict) -> dict:
    """The options of DOT: flags, else settings, else on, light, LR, curved."""
    out = {"clusters": True, "legend": True, "theme": "light", "rankdir": "LR", "splines": "curved", "rounded": True} | {k: v for k, v in settings.get("dot", {}).items() if k in config.SETTINGS["dot"]}
    for name in out:
        if (flag := getattr(a, f"dot_{name}")) is not None:
            out[name] = ON_OFF.get(flag, flag)
    return out


def _root(a, settings: dict) -> str:
    path = a.path or settings.get("root") or "."
    return tree.project_root() if path == "." else path


def _graph(spark: SparkSession, a, settings: dict) -> CodeGraph:
    if a.graph:
        return document.load(spark, a.graph) if a.graph.endswith(".json") else store.load(spark, a.graph)
    mode = CacheMode.REBUILD if getattr(a, "rebuild", False) else CacheMode.IGNORE if getattr(a, "no_cache", False) else CacheMode.USE
    return build_tree(spark, _root(a, settings), mode, not a.no_ignore)


def _build(g: CodeGraph, a, settings: dict) -> int:
    for target, save in ((a.save, document.save if (a.save or "").endswith(".json") else store.save), (a.json, document.save)):
        if target:
            save(g, target)
    if a.dot or a.svg:
        text = dot.document(g, **_drawing(a, settings))
        interactive = ON_OFF[a.svg_interactive] if a.svg_interactive else settings.get("svg", {}).get("interactive", True)
        for target, content in ((a.dot, lambda: text), (a.svg, lambda: dot.svg(text, interactive))):
            if target:
                with open(target, "w", encoding="utf-8") as f:
                    f.write(content())
    if not a.quiet:
        print(f"{g.files.count()} files, {g.items.count()} items, {g.relationships.count()} relationships")
    return 0


def _failure(e: Exception) -> WeftError | None:
    """The error of this library that an exception stands for, if it does."""
    if isinstance(e, WeftError):
        return e
    text = str(e)
    if tree.NOT_UTF8 in text:
        return ParseError(tree.NOT_UTF8 + text.split(tree.NOT_UTF8, 1)[1].split("\n")[0].split(" SQLSTATE")[0])
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    if a.command == "completions":
        print(_completions(top, a.shell), end="")
        return 0
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    settings = config.load(a.config)
    try:
        g = _graph(spark, a, settings)
        if a.command == "build":
            return _build(g, a, settings)
        wanted = a.format or settings.get("query", {}).get("default_format", "text")
        a.format = wanted if wanted in ("text", "json") else "text"
        if a.query == "item-info":
            return _item(g, a, settings)
        df, order = _answer(g, a)
        rows = queries.page(df, order, a.offset, a.limit).collect()
    except Exception as e:  # the command line reports any error and says so by its exit code
        print(f"error: {_failure(e) or e}", file=sys.stderr)
        return 1
    print(table.as_json(_as_json(a.query, rows)) if a.format == "json" else _as_text(a.query, rows, a))
    return 0


def _named(g: CodeGraph, a, settings: dict) -> str:
    """The id of the best item of a name."""
    if not a.name:
        raise QueryError("item-info needs --item-id or --name")
    root = a.path or settings.get("root") or os.getcwd()
    found = queries.item_lookup(g, a.name, a.kind, root).limit(11).collect()
    best = [r for r in found if r["rank"] == 1]
    if not best:
        raise QueryError(f"no item is named {a.name!r}")
    if len(best) > 1:
        raise QueryError("\n".join([f"the name {a.name!r} is ambiguous; --item-id or --kind tells apart:", *[f"- id={r['item_id']}  kind={r['kind']}  path={r['path']}" for r in found[:10]]]))
    return best[0]["item_id"]


def _item(g: CodeGraph, a, settings: dict) -> int:
    """One result: the item's details, or null (text: <item not found>). JSON has code and contexts only with -v."""
    item = a.item_id or _named(g, a, settings)
    full = bool(a.verbose)
    row = queries.item_details(g, item, full).first()
    info = row.asDict(recursive=True) if row else None
    if info and a.format == "text" and not a.show_code:
        info["code"] = None
    print(table.as_json(info) if a.format == "json" else table.item(info, full))
    return 0


if __name__ == "__main__":
    sys.exit(main())
