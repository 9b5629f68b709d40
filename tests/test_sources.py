import json
import os
from pathlib import Path

from weftgraph import cli
from weftgraph.plans.build import CACHE_FOLDER, build_tree
from weftgraph.render import dot, table
from weftgraph.sources import cache, config, document, tree
from weftgraph.sources.cache import CacheMode


def project(folder, files):
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(folder)


def names(root, **options):
    return [p.removeprefix(root + "/") for p, _, _ in tree.discover(root, **options)]


def test_ignore_rules(tmp_path):
    root = project(tmp_path, {".gitignore": "target/\n*.gen.rs\n!keep.gen.rs\n/top.rs\n", "src/.ignore": "skip_*.rs\n", "src/a.rs": "", "src/b.gen.rs": "", "src/keep.gen.rs": "", "src/skip_me.rs": "", "src/_x.rs": "", "src/top.rs": "", "top.rs": "", "target/t.rs": "", ".hidden/h.rs": "", "src/n.txt": "", "src/d/.gitignore": "!skip_it.rs\n", "src/d/skip_it.rs": ""})
    assert names(root) == ["src/_x.rs", "src/a.rs", "src/d/skip_it.rs", "src/keep.gen.rs", "src/top.rs"]
    assert "target/t.rs" in names(root, ignore_rules=False) and "src/skip_me.rs" in names(root, ignore_rules=False)


def test_project_root(tmp_path):
    root = project(tmp_path, {"Cargo.toml": "", "src/deep/a.rs": ""})
    assert tree.project_root(root + "/src/deep") == root


def test_commands(spark, tmp_path, capsys):
    root = project(tmp_path / "p", {"src/lib.rs": "\nmod a;\nuse crate::a::foo;\npub fn top() { foo(); }\n", "src/a.rs": "pub fn foo() {}\n"})
    saved = str(tmp_path / "g")
    assert cli.main(["build", "-p", root, "--save", saved, "--dot", str(tmp_path / "g.dot")], spark) == 0
    assert "2 files" in capsys.readouterr().out and "digraph" in (tmp_path / "g.dot").read_text()
    assert cli.main(["query", "connected-files", f"{root}/src/a.rs", "--graph", saved, "-f", "json"], spark) == 0
    assert f"{root}/src/lib.rs" in capsys.readouterr().out
    assert cli.main(["query", "item-info", "--name", "nothing", "--graph", saved], spark) == 1


def test_manifest(spark):
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, mtime bigint, len bigint")
    now = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, mtime bigint, len bigint")
    assert dict(map(tuple, cache.diff(before, now).collect())) == {"a": "same", "b": "changed", "c": "gone", "d": "new"}
    assert {r.path for r in cache.to_parse(before, now).collect()} == {"b", "d"}
    assert {r.path for r in cache.reusable(before.select("path"), before, now).collect()} == {"a"}


def test_renderers():
    assert table.grid(["a", "bb"], [["é", None], ["xyz"]]).splitlines()[0] == "+-----+----+"
    assert dot.with_interaction("<svg></svg>").endswith("</svg>") and dot.with_interaction("x").startswith("x<style>")


def test_documents(spark, tmp_path, capsys):
    root = project(tmp_path / "p", {"src/lib.rs": "\nmod a;\nuse crate::a::foo as f;\npub fn top() { foo(); }\n", "src/a.rs": "pub(in crate::x) fn foo() {}\npub enum E { A }\n", "src/empty.rs": ""})
    saved, back = str(tmp_path / "g"), str(tmp_path / "g.json")
    assert cli.main(["-q", "build", "-p", root, "--save", saved, "--json", back], spark) == 0 and capsys.readouterr().out == ""
    from weftgraph.sources import store

    a, b = store.load(spark, saved), document.load(spark, back)
    for name, key in (("items", "item_id"), ("imports", "import_path"), ("relationships", "from_item")):
        columns = [c for c in getattr(a, name).columns if c != "attrs"]
        assert sorted(map(str, getattr(a, name).select(columns).collect())) == sorted(map(str, getattr(b, name).select(columns).collect())), (name, key)
    assert b.files.count() == 3
    whole = json.loads(open(back).read())
    node = whole["files"][f"{root}/src/a.rs"]
    assert node["metrics"] == {"item_count": 3, "import_count": 0} and node["items"][0]["item_type"] == {"Module": {"is_inline": False}}
    assert {"PubIn": "in crate::x"} in [x["visibility"] for x in node["items"]] and whole["module_parent"][f"{root}/src/a.rs"] == f"{root}/src/lib.rs"
    assert cli.main(["query", "hubs", "--graph", back], spark) == 0
    assert capsys.readouterr().out.splitlines()[1].split() == ["|", "Path", "|", "Total", "|"]
    assert cli.main(["-v", "query", "hubs", "--graph", back], spark) == 0
    assert capsys.readouterr().out.splitlines()[1].split() == ["|", "Path", "|", "In", "|", "Out", "|", "Total", "|"]
    (tmp_path / "bad.json").write_text("[]")
    assert cli.main(["query", "cycles", "--graph", str(tmp_path / "bad.json")], spark) == 1


def test_settings(spark, tmp_path, capsys):
    root = project(tmp_path / "p", {"src/lib.rs": "pub fn top() {}\n"})
    settings = tmp_path / "s.toml"
    settings.write_text(f'root = "{root}"\n[dot]\ntheme = "dark"\nlegend = false\n[query]\ndefault_format = "json"\n')
    out = tmp_path / "g.dot"
    assert cli.main(["build", "-c", str(settings), "--dot", str(out), "--dot-rankdir", "TB"], spark) == 0
    text = out.read_text()
    assert "rankdir=TB" in text and "Legend" not in text and dot.COLOURS["dark"]["Function"] in text
    capsys.readouterr()
    assert cli.main(["query", "hubs", "-c", str(settings)], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["path"] == f"{root}/src/lib.rs"
    assert cli.main(["query", "hubs", "-c", str(settings), "-f", "text"], spark) == 0 and capsys.readouterr().out.startswith("+")
    settings.write_text("root = 1\n")
    assert config.load(str(settings)) == {} == config.load(str(tmp_path / "none.toml"))


def test_cache_modes(spark, tmp_path):
    """Two files, then one changed, then one gone: entries 2, 2, 1. Unchanged files come from the cache, read or not."""
    root = project(tmp_path / "p", {"src/lib.rs": "pub fn a() {}\npub mod m;\n", "src/m.rs": "pub fn b() {}\n"})
    folder = f"{root}/{CACHE_FOLDER}"
    entries = lambda: {r.path.removeprefix(root): (r.mtime, r.len) for r in cache.load(spark, folder).files.collect()}
    built = lambda mode=CacheMode.USE: sorted((r.item_id) for r in build_tree(spark, root, mode).items.filter("ordinal > 0").collect())
    assert cache.load(spark, folder) is None
    assert built() == ["fn:a:1", "fn:b:1"] and len(first := entries()) == 2
    project(tmp_path / "p", {"src/m.rs": "pub fn b() {}\npub fn c() {}\n"})
    assert built() == ["fn:a:1", "fn:b:1", "fn:c:2"] and len(entries()) == 2
    assert entries()["/src/m.rs"] != first["/src/m.rs"] and entries()["/src/lib.rs"] == first["/src/lib.rs"]
    lib = tmp_path / "p/src/lib.rs"
    before = lib.stat()
    lib.write_text("pub fn z() {}\npub mod m;\n")  # of the same length
    os.utime(lib, (before.st_atime, before.st_mtime))
    assert "fn:a:1" in built() and "fn:z:1" in built(CacheMode.IGNORE) and "fn:z:1" in built()
    (tmp_path / "p/src/m.rs").unlink()
    assert built() == ["fn:z:1"] and len(entries()) == 1
    assert built(CacheMode.REBUILD) == ["fn:z:1"] and [p.name for p in Path(folder).iterdir() if p.name.startswith("gen")] == ["gen-1"]
    cache.clear(spark, folder)
    assert cache.load(spark, folder) is None


def test_cache_flags_and_errors(spark, tmp_path, capsys):
    root = project(tmp_path / "p [x]", {"src/lib.rs": "\n  pub fn f() {}\n", "src/a b.rs": "fn g() { f(); }\n"})
    for flag in ([], ["--rebuild"], ["--no-cache"]):
        assert cli.main(["build", "--path", root, "--json", str(tmp_path / "g.json"), *flag], spark) == 0
    assert json.loads((tmp_path / "g.json").read_text())["metadata"]["generated_at"].isdigit()
    capsys.readouterr()
    (tmp_path / "p [x]/src/bad.rs").write_bytes(b"fn x() {}\xff")
    assert cli.main(["build", "--path", root], spark) == 1
    assert capsys.readouterr().err.strip() == f"error: Invalid UTF-8 in file {root}/src/bad.rs"
    assert len(cache.load(spark, f"{root}/{CACHE_FOLDER}").files.collect()) == 2


def test_item_info_and_row_numbers(spark, tmp_path, capsys):
    root = project(tmp_path / "p", {"src/lib.rs": "mod a;\nmod b;\npub fn twice() {}\n", "src/a.rs": "use crate::twice;\npub fn one() { twice(); }\n", "src/b.rs": "use crate::twice;\nfn one() { twice(); }\n", "vendor/src/v.rs": "fn twice() {}\n"})
    saved = str(tmp_path / "g")
    assert cli.main(["-q", "build", "-p", root, "--save", saved], spark) == 0
    ask = lambda *words: (cli.main([*words, "-p", root, "--graph", saved], spark), capsys.readouterr())
    code, out = ask("query", "item-info", "--name", "twice", "--kind", "function", "-f", "json")
    info = json.loads(out.out)
    assert code == 0 and info["id"] == "fn:twice:3" and info["visibility"] == "public" and info["code"] is None
    assert {(r["id"], r["name"], r["relation"], r["context"]) for r in info["inbound"]} >= {(f"file:{root}/src/a.rs", "a", "Calls:heuristic", "")}
    code, out = ask("-v", "query", "item-info", "--item-id", "fn:twice:3", "-f", "json")
    assert "pub fn twice" in json.loads(out.out)["code"] and {r["context"] for r in json.loads(out.out)["inbound"]} >= {"twice", "auto"}
    code, out = ask("query", "item-info", "--name", "one")
    assert code == 1 and "ambiguous" in out.err and out.err.count("id=fn:one:2") == 2
    assert ask("query", "item-info", "--item-id", "fn:none:1", "-f", "json")[1].out.strip() == "null"
    assert ask("query", "item-info", "--item-id", "fn:none:1")[1].out.strip() == "<item not found>"
    assert "Callees: <none>" in ask("query", "item-info", "--item-id", "fn:twice:3")[1].out
    assert ask("query", "item-info", "--name", "nothing")[0] == 1
    rows = ask("query", "connected-files", f"{root}/src/lib.rs", "--offset", "1")[1].out.splitlines()
    assert rows[1].split() == ["|", "#", "|", "Path", "|"] and rows[3].split()[1] == "2"
    assert ask("query", "path", f"{root}/vendor/src/v.rs", f"{root}/src/a.rs")[1].out.strip() == "<no path>"


def test_settings_of_a_root(tmp_path):
    root = project(tmp_path, {"weftgraph.toml": "[query]\ndefault_format = 'json'\n"})
    assert config.near(root)["query"]["default_format"] == "json" and config.near(root + "/nowhere") == {}


def test_completions(capsys):
    for shell in cli.SHELLS:
        assert cli.main(["completions", shell]) == 0
        assert "module-centrality" in capsys.readouterr().out
