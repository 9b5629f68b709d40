"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import extract, queries, relate, resolve, traverse
from ..operators.catalog import Ask
from ..render import dot
from ..sources import adapters, cache
from ..sources.shared import checkpointed
from .build import build, parsed, refreshed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# ---- the trade graph in SQL -------------------------------------------------------------------------------------------

_TRADE = """
WITH nf AS (SELECT n_nationkey, 'src/r' || n_regionkey || '/n' || n_nationkey || '.rs' AS path FROM nation),
files AS (
  SELECT 'src/lib.rs' AS path UNION ALL SELECT 'src/parts/mod.rs' UNION ALL SELECT 'src/r' || r_regionkey || '/mod.rs' FROM region
  UNION ALL SELECT path FROM nf UNION ALL SELECT DISTINCT 'src/parts/' || replace(lower(p_brand), '#', '') || '.rs' FROM part),
own AS (
  SELECT path, s_suppkey + 1 AS k, 'fn:supplier_' || (s_suppkey + 1) || ':' || (s_suppkey + 1) AS item_id, 'Function' AS kind, 'supplier_' || (s_suppkey + 1) AS name FROM supplier JOIN nf ON s_nationkey = n_nationkey
  UNION ALL SELECT path, c_custkey + 1, 'struct:customer_' || (c_custkey + 1) || ':' || (c_custkey + 1), 'Struct', 'customer_' || (c_custkey + 1) FROM customer JOIN nf ON c_nationkey = n_nationkey
  UNION ALL SELECT 'src/parts/' || replace(lower(p_brand), '#', '') || '.rs', p_partkey + 1, 'enum:part_' || (p_partkey + 1) || ':' || (p_partkey + 1), 'Enum', 'part_' || (p_partkey + 1) FROM part),
items AS (
  SELECT path, 0 AS ordinal, 'file:' || path AS item_id, 'Module' AS kind, regexp_extract(path, '([^/]+)\\.rs$', 1) AS name, 'PubCrate' AS visibility FROM files
  UNION ALL SELECT path, k, item_id, kind, name, CASE k % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private' ELSE 'PubCrate' END FROM own),
parent AS (
  SELECT path, CASE WHEN path LIKE 'src/r%/mod.rs' OR path = 'src/parts/mod.rs' THEN 'src/lib.rs' WHEN path <> 'src/lib.rs' THEN regexp_replace(path, '[^/]+$', 'mod.rs') END AS up FROM files),
rel AS (
  SELECT 'file:' || path AS from_item, item_id AS to_item, 'Contains' AS rel_type, 'file_contains' AS rel_detail FROM items WHERE ordinal > 0
  UNION ALL SELECT 'file:' || up, 'file:' || path, 'Contains', 'module_contains' FROM parent WHERE up IS NOT NULL
  UNION ALL SELECT 'file:' || nf.path, 'fn:supplier_' || (l_suppkey + 1) || ':' || (l_suppkey + 1), 'Calls', 'trade' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nf ON c_nationkey = n_nationkey
  UNION ALL SELECT * FROM (SELECT DISTINCT 'file:' || nf.path, 'enum:part_' || (l_partkey + 1) || ':' || (l_partkey + 1), 'Uses', 'import-item' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nf ON s_nationkey = n_nationkey)),
owner AS (SELECT item_id, max(path) AS path FROM items GROUP BY item_id),
fe AS (SELECT a.path AS src, b.path AS dst, rel_type FROM rel JOIN owner a ON from_item = a.item_id JOIN owner b ON to_item = b.item_id WHERE a.path <> b.path)
"""
_ONE = "src/r0/n0.rs"


def _query(name: str, sql: str | None, prefix: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = prefix + sql
        return f

    return add


def _trade(name: str, sql: str | None):
    def add(f):
        _query(name, sql, _TRADE)(lambda spark, sf_dir: f(adapters.trade_graph(spark, sf_dir)))
        return f

    return add


def _degree_sql(edges: str, nodes: str, name: str, metric: str, top: int) -> str:
    order = {"in": "indegree", "out": "outdegree", "total": "indegree + outdegree"}[metric]
    return f""", e AS ({edges}), n AS ({nodes}),
g AS (SELECT n.key, (SELECT count(*) FROM e WHERE dst = n.key) AS indegree, (SELECT count(*) FROM e WHERE src = n.key) AS outdegree FROM n)
SELECT key AS {name}, CAST(indegree AS BIGINT) AS indegree, CAST(outdegree AS BIGINT) AS outdegree FROM g ORDER BY {order} DESC, string_split(key, '/') LIMIT {top}"""


for _metric in ("in", "out", "total"):
    _trade(f"hubs_{_metric}", _degree_sql("SELECT src, dst FROM fe", "SELECT path AS key FROM files", "path", _metric, 10))(lambda g, m=_metric: queries.hubs(g, m))
_trade("module_centrality", _degree_sql("SELECT * FROM (SELECT regexp_replace(src, '/[^/]+$', '') AS src, regexp_replace(dst, '/[^/]+$', '') AS dst FROM fe) WHERE src <> dst", "SELECT DISTINCT regexp_replace(path, '/[^/]+$', '') AS key FROM files", "module", "total", 10))(queries.module_centrality)


@_trade("hubs_page", _degree_sql("SELECT src, dst FROM fe", "SELECT path AS key FROM files", "path", "total", 20) + " OFFSET 5")
def _(g):
    """Pagination: rows 6 to 25 of the files by total degree."""
    return queries.page(queries.hubs(g, "total", None), [(F.col("indegree") + F.col("outdegree")).desc(), paths.parts("path")], 5, 20)


@_trade("connected_files", f"SELECT DISTINCT CASE WHEN src = '{_ONE}' THEN dst ELSE src END AS path FROM fe WHERE src = '{_ONE}' OR dst = '{_ONE}'")
def _(g):
    return queries.connected_files(g, _ONE)


@_trade("function_usage_callers", "SELECT DISTINCT o.path FROM rel JOIN owner o ON from_item = o.item_id WHERE to_item IN (SELECT item_id FROM items WHERE kind = 'Function' AND name = 'supplier_1')")
def _(g):
    return queries.function_usage(g, "supplier_1", "callers")


@_query("function_usage_callees", "SELECT DISTINCT o.path FROM (SELECT from_item, to_item FROM rel UNION ALL SELECT 'fn:supplier_' || (l_suppkey + 1) || ':' || (l_suppkey + 1), 'enum:part_' || (l_partkey + 1) || ':' || (l_partkey + 1) FROM lineitem) r JOIN owner o ON to_item = o.item_id WHERE from_item IN (SELECT item_id FROM items WHERE kind = 'Function' AND name = 'supplier_1')", _TRADE)
def _(spark, sf_dir):
    """Suppliers as functions that use the parts they supply."""
    g = adapters.trade_graph(spark, sf_dir)
    g.relationships = g.relationships.unionByName(adapters.supplied_parts(spark, sf_dir))
    return queries.function_usage(g, "supplier_1", "callees")


@_trade("item_owner_dedup", "SELECT item_id, path FROM owner")
def _(g):
    return g.item_owner()


@_trade("file_edges", "SELECT src AS src_path, dst AS dst_path, rel_type, CAST(count(*) AS BIGINT) AS edges FROM fe GROUP BY ALL")
def _(g):
    return g.file_edges().groupBy("src_path", "dst_path", "rel_type").agg(F.sum("n").alias("edges"))


@_trade("rel_file_contains", "SELECT from_item, to_item, rel_type, rel_detail FROM rel WHERE rel_detail = 'file_contains'")
def _(g):
    return relate.file_contains(g.items).select("from_item", "to_item", "rel_type", "rel_detail")


@_trade("rel_module_contains", "SELECT from_item, to_item, rel_type, rel_detail FROM rel WHERE rel_detail = 'module_contains'")
def _(g):
    return relate.module_contains(g.files).select("from_item", "to_item", "rel_type", "rel_detail")


_trade("module_parent", f"SELECT up AS path FROM parent WHERE path = '{_ONE}'")(lambda g: queries.module_parent(g, _ONE))
_trade("module_children", "SELECT path FROM parent WHERE up = 'src/lib.rs'")(lambda g: Ask("module-children", {"file": "src/lib.rs"}).run(g))


_KINDS = "CASE visibility WHEN 'Public' THEN 'public' WHEN 'PubCrate' THEN 'pub(crate)' ELSE 'private' END"
_UNUSED = f"SELECT path, item_id AS id, name, kind, {_KINDS} AS visibility FROM items WHERE ordinal > 0 AND item_id NOT IN (SELECT to_item FROM rel WHERE rel_type IN ('Uses', 'Calls'))"


@_trade("unreferenced_private", _UNUSED + " AND visibility <> 'Public'")
def _(g):
    return queries.unreferenced_items(g)


@_trade("unreferenced_all_excluding", _UNUSED + " AND NOT regexp_matches(path, 'r[12]/|parts')")
def _(g):
    return queries.unreferenced_items(g, True, "r[12]/|parts")


_INFO = "SELECT {far} AS item_id, o.path, rel_type || ':' || rel_detail AS relation FROM rel JOIN owner o ON o.item_id = {far} WHERE {near} = '{id}'"


@_trade("item_info_inbound", _INFO.format(near="to_item", far="from_item", id="fn:supplier_1:1"))
def _(g):
    return queries.item_relations(g, "fn:supplier_1:1", "inbound").select("item_id", "path", "relation")


@_trade("item_info_outbound", _INFO.format(near="from_item", far="to_item", id=f"file:{_ONE}"))
def _(g):
    return queries.item_relations(g, f"file:{_ONE}", "outbound").select("item_id", "path", "relation")


@_trade("item_info", f"SELECT item_id, path, kind, name, {_KINDS} AS visibility, CAST(ordinal AS BIGINT) AS line_start, CAST(ordinal AS BIGINT) AS line_end FROM items WHERE item_id = 'fn:supplier_1:1'")
def _(g):
    return queries.item_info(g, "fn:supplier_1:1")


@_trade("item_details", f"""SELECT i.item_id AS id, i.name, i.kind, {_KINDS} AS visibility, i.path, CAST(i.ordinal AS BIGINT) AS line_start,
  (SELECT string_agg(e.item_id || ' ' || e.name || ' ' || e.path || ' ' || rel_type || ':' || rel_detail, ',' ORDER BY e.item_id, e.name, e.path, rel_type) FROM rel JOIN items e ON e.item_id = from_item WHERE to_item = i.item_id) AS inbound,
  (SELECT count(*) FROM rel JOIN items e ON e.item_id = to_item WHERE from_item = i.item_id) AS outbound
  FROM items i WHERE i.item_id = 'fn:supplier_1:1'""")
def _(g):
    ends = F.transform("inbound", lambda e: F.concat_ws(" ", e["id"], e["name"], e["path"], e["relation"]))
    return queries.item_details(g, "fn:supplier_1:1", True).select("id", "name", "kind", "visibility", "path", "line_start", F.array_join(ends, ",").alias("inbound"), F.size("outbound").cast("bigint").alias("outbound"))


@_trade("item_lookup_ranked", "SELECT item_id, path, lower(kind) AS kind, len(string_split(path, '/')) - 1 AS depth, rank() OVER (ORDER BY len(string_split(path, '/'))) AS rank FROM items WHERE name = 'mod'")
def _(g):
    return queries.item_lookup(g, "mod").select("item_id", "path", "kind", F.col("depth").cast("bigint").alias("depth"), "rank")


@_query("trait_impls", "SELECT 'src/x' || s_nationkey || '.rs' AS path, s_name AS type FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, sf_dir):
    """Impl items come from hand-made graphs only: suppliers as types, every second one with the trait."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    trait = F.when(F.col("s_suppkey") % 2 == 0, "Display").otherwise("Debug")
    path = F.format_string("src/x%d.rs", "s_nationkey")
    items = s.select(path.alias("path"), F.lit(1).alias("ordinal"), F.concat(F.lit("impl:"), "s_name").alias("item_id"), F.lit("Impl").alias("kind"), F.col("s_name").alias("name"), extract.attributes(trait_name=trait, type_name=F.col("s_name")).alias("attrs"))
    g = adapters.trade_graph(spark, sf_dir)
    g.items = items
    return queries.trait_impls(g, "Display")


_SPARSE = """
WITH RECURSIVE nf AS (SELECT n_nationkey, 'src/r' || n_regionkey || '/n' || n_nationkey || '.rs' AS path FROM nation),
t AS (SELECT c_nationkey, s_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, s_nationkey) AS k FROM t),
e AS (SELECT a.path AS u, b.path AS v FROM k JOIN nf a ON c_nationkey = a.n_nationkey JOIN nf b ON s_nationkey = b.n_nationkey WHERE k <= 2),
reach AS (SELECT u AS s, v AS t FROM e UNION SELECT s, v FROM reach JOIN e ON t = u)
"""


@_query("cycle_members", "SELECT s AS path FROM reach WHERE s = t", _SPARSE)
def _(spark, sf_dir):
    return traverse.cycle_members(adapters.sparse_trade_graph(spark, sf_dir))


# A depth-first search step by step: the files on the trail, which neighbour of each is next, the files seen, and the cycle
# that the step closes.
_DFS = _SPARSE.replace("reach AS (SELECT u AS s, v AS t FROM e UNION SELECT s, v FROM reach JOIN e ON t = u)", """adj AS (SELECT u, list(v ORDER BY string_split(v, '/')) AS vs FROM e GROUP BY u),
ns AS (SELECT list(p ORDER BY string_split(p, '/')) AS ps FROM (SELECT u AS p FROM e UNION SELECT v FROM e)),
dfs AS (
  SELECT 0 AS step, CAST([] AS VARCHAR[]) AS trail, CAST([] AS BIGINT[]) AS ptr, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR[]) AS hit
  UNION ALL SELECT step + 1,
    CASE WHEN root IS NOT NULL THEN [root] WHEN v IS NULL THEN list_slice(trail, 1, len(trail) - 1) WHEN NOT list_contains(seen, v) THEN list_append(trail, v) ELSE trail END,
    CASE WHEN root IS NOT NULL THEN [CAST(1 AS BIGINT)] WHEN v IS NULL THEN list_slice(ptr, 1, len(ptr) - 1) WHEN NOT list_contains(seen, v) THEN list_append(list_append(list_slice(ptr, 1, len(ptr) - 1), ptr[len(ptr)] + 1), 1) ELSE list_append(list_slice(ptr, 1, len(ptr) - 1), ptr[len(ptr)] + 1) END,
    CASE WHEN root IS NOT NULL THEN list_append(seen, root) WHEN v IS NOT NULL AND NOT list_contains(seen, v) THEN list_append(seen, v) ELSE seen END,
    CASE WHEN v IS NOT NULL AND list_contains(trail, v) THEN list_slice(trail, list_position(trail, v), len(trail)) END
  FROM (SELECT dfs.*, CASE WHEN len(trail) = 0 THEN list_filter(ps, lambda x: NOT list_contains(seen, x))[1] END AS root, CASE WHEN len(trail) > 0 THEN vs[ptr[len(ptr)]] END AS v FROM dfs CROSS JOIN ns LEFT JOIN adj ON adj.u = trail[len(trail)])
  WHERE len(trail) > 0 OR root IS NOT NULL)
""")


@_query("cycles", "SELECT row_number() OVER (ORDER BY step) - 1 AS cycle, array_to_string(hit, ' -> ') AS files, CAST(len(hit) AS BIGINT) AS length FROM dfs WHERE hit IS NOT NULL", _DFS)
def _(spark, sf_dir):
    return traverse.cycles(adapters.sparse_trade_graph(spark, sf_dir))


_WALK = _SPARSE.replace("reach AS (SELECT u AS s, v AS t FROM e UNION SELECT s, v FROM reach JOIN e ON t = u)", "walk AS (SELECT 'src/r0/n0.rs' AS node, 0 AS step UNION SELECT v, step + 1 FROM walk JOIN e ON node = u WHERE step < 25)")


@_query("shortest_path_lengths", "SELECT node AS path, CAST(min(step) AS BIGINT) AS step FROM walk GROUP BY node", _WALK)
def _(spark, sf_dir):
    """The length of the shortest path from one file to each file that it reaches (itself included)."""
    return traverse.distances(adapters.sparse_trade_graph(spark, sf_dir), "src/r0/n0.rs").select("path", "step")


def _path_sql(target: str) -> str:
    """From walk (node, step) and e (u, v): each file follows the smallest predecessor."""
    return f""", lev AS (SELECT node, min(step) AS step FROM walk GROUP BY node),
par AS (SELECT b.node, arg_min(a.node, string_split(a.node, '/')) AS parent FROM e JOIN lev a ON a.node = u JOIN lev b ON b.node = v WHERE b.step = a.step + 1 GROUP BY b.node),
back AS (SELECT node, step FROM lev WHERE node = '{target}' UNION ALL SELECT parent, step - 1 FROM back JOIN par USING (node))
SELECT CAST(step AS BIGINT) AS step, node AS path FROM back"""


@_query("shortest_path", _TRADE.replace("WITH nf", "WITH RECURSIVE nf", 1) + f", e AS (SELECT DISTINCT src AS u, dst AS v FROM fe), walk AS (SELECT '{_ONE}' AS node, 0 AS step UNION SELECT v, step + 1 FROM walk JOIN e ON node = u WHERE step < 6)" + _path_sql("src/parts/brand12.rs"))
def _(spark, sf_dir):
    return traverse.shortest_path(adapters.trade_graph(spark, sf_dir), _ONE, "src/parts/brand12.rs")


@_query("shortest_path_sparse", _WALK + _path_sql("src/r4/n14.rs"))
def _(spark, sf_dir):
    return traverse.shortest_path(adapters.sparse_trade_graph(spark, sf_dir), "src/r0/n0.rs", "src/r4/n14.rs")


# Blocks of six suppliers: those with an even number are rings, the others chains that lead into the next ring.
_RINGS = """
WITH s AS (SELECT s_suppkey AS k, s_suppkey // 6 AS b, 'src/b' || (s_suppkey // 6) || '/s' || s_suppkey || '.rs' AS path FROM supplier),
c AS (SELECT b, count(*) AS n, min(k) AS lowest, arg_min(k, path) AS least, min(path) AS root FROM s GROUP BY b),
ring AS (SELECT c.b, c.n, CASE WHEN p.root < c.root THEN c.lowest ELSE c.least END AS entry, CASE WHEN p.root < c.root THEN p.root ELSE c.root END AS root FROM c LEFT JOIN c p ON p.b = c.b - 1 WHERE c.b % 2 = 0 AND c.n > 1)
"""


@_query("cycle_members_rings", _RINGS + "SELECT path FROM s JOIN ring USING (b)")
def _(spark, sf_dir):
    return traverse.cycle_members(adapters.ring_graph(spark, sf_dir))


@_query("cycles_rings", _RINGS + "SELECT row_number() OVER (ORDER BY root) - 1 AS cycle, string_agg(path, ' -> ' ORDER BY (k - entry + n) % n) AS files, CAST(n AS BIGINT) AS length FROM s JOIN ring USING (b) GROUP BY b, n, root")
def _(spark, sf_dir):
    return traverse.cycles(adapters.ring_graph(spark, sf_dir))


@_query("shortest_path_rings", _RINGS + "SELECT CAST(k - 6 AS BIGINT) AS step, path FROM s WHERE k BETWEEN 6 AND 17 AND (SELECT max(k) FROM s) >= 17")
def _(spark, sf_dir):
    return traverse.shortest_path(adapters.ring_graph(spark, sf_dir), "src/b1/s6.rs", "src/b2/s17.rs")


# ---- generated sources in SQL -----------------------------------------------------------------------------------------

# Closed forms: what each generated file holds, written down from how it is generated, without any pattern.
_SOURCES = r"""
WITH s0 AS (SELECT s_suppkey AS k, s_nationkey AS n, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS j FROM supplier),
s AS (SELECT k, n, j, 'src/m' || n || '/s' || k || '.rs' AS path, CASE WHEN j IS NULL THEN 0 ELSE 1 END AS has FROM s0),
m AS (SELECT n_nationkey AS n, 'src/m' || n_nationkey || '/mod.rs' AS path FROM nation),
src AS (SELECT path FROM s UNION ALL SELECT path FROM m UNION ALL SELECT 'src/lib.rs'),
items AS (
  SELECT path, 0 AS ordinal, 'file:' || path AS item_id, 'Module' AS kind, regexp_extract(path, '([^/]+)\.rs$', 1) AS name, 'PubCrate' AS visibility, CAST(NULL AS VARCHAR) AS vis_scope, 1 AS line FROM src
  UNION ALL SELECT path, 1, 'fn:f' || k || ':' || (3 + has), 'Function', 'f' || k, 'Public', NULL, 3 + has FROM s
  UNION ALL SELECT path, 2, 'fn:run' || k || ':' || (10 + has), 'Function', 'run' || k, 'PubIn', 'in crate::m' || n, 10 + has FROM s
  UNION ALL SELECT path, 3, 'struct:S' || k || ':' || (6 + has), 'Struct', 'S' || k, 'Private', NULL, 6 + has FROM s
  UNION ALL SELECT path, 4, 'enum:E' || k || ':' || (8 + has), 'Enum', 'E' || k, 'PubCrate', NULL, 8 + has FROM s
  UNION ALL SELECT path, 1, 'fn:top' || n || ':1', 'Function', 'top' || n, 'Public', NULL, 1 FROM m),
imports AS (
  SELECT path, 0 AS ordinal, 'crate::m' || n || '::s' || j || '::f' || j AS import_path, CAST(NULL AS VARCHAR) AS alias FROM s WHERE j IS NOT NULL
  UNION ALL SELECT path, has, 'crate::m' || n || '::top' || n, 'up' || k FROM s)
"""


def _sources(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(adapters.supplier_sources(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


for _name, _kind in (("extract_functions", "Function"), ("extract_structs", "Struct"), ("extract_enums", "Enum")):
    _sources(_name, _SOURCES + f"SELECT path, item_id, name, visibility, CAST(line AS BIGINT) AS line_start FROM items WHERE kind = '{_kind}'")(lambda files, k=_kind: extract.items_of(files, k).select("path", "item_id", "name", "visibility", "line_start"))


@_sources("extract_imports", _SOURCES + "SELECT path, CAST(ordinal AS INTEGER) AS ordinal, import_path, alias FROM imports")
def _(files):
    return extract.imports(files)


@_sources("file_items", _SOURCES + "SELECT path, ordinal, item_id, name FROM items WHERE ordinal = 0")
def _(files):
    return extract.file_items(files).select("path", "ordinal", "item_id", "name")


_METRICS = "SELECT path, (SELECT count(*) FROM items i WHERE i.path = src.path) AS item_count, (SELECT count(*) FROM imports i WHERE i.path = src.path) AS import_count FROM src"


@_sources("file_metrics", _SOURCES + _METRICS)
def _(files):
    return extract.metrics(extract.items(files), extract.imports(files))


@_sources("build_incremental", _SOURCES + f", c AS ({_METRICS}), t AS (SELECT path, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 5 = 1 THEN 'changed' ELSE 'same' END AS state FROM s) SELECT c.path, coalesce(state, 'same') AS state, item_count, import_count FROM c LEFT JOIN t USING (path)")
def _(files):
    """A scan after another: a fifth of the suppliers' files are new, a fifth had another content, and one file is gone."""
    k = F.regexp_extract("path", r"/s([0-9]+)\.rs$", 1).try_cast("int") % 5
    files = checkpointed(files)
    gone = files.filter("path = 'src/lib.rs'").withColumn("path", F.lit("src/gone.rs"))
    old = files.filter(F.coalesce(k, F.lit(2)) != 0).withColumns({"content": F.when(k == 1, "fn other() {}").otherwise(F.col("content")), "len": F.when(k == 1, 13).otherwise(F.col("len"))})
    before = cache.Parsed(*parsed(old.unionByName(gone)))
    todo = cache.to_parse(before.files, files).select(files.columns)
    found = refreshed(before, files, todo)
    return extract.metrics(found.items, found.imports).join(cache.diff(before.files, files), "path").select("path", "state", "item_count", "import_count")


@_sources("module_segments", _SOURCES + " SELECT path, CASE WHEN path = 'src/lib.rs' THEN '' ELSE regexp_replace(regexp_replace(substr(path, 5), '(/mod)?\\.rs$', ''), '/', '::', 'g') END AS module FROM src")
def _(files):
    return files.select("path", F.array_join(paths.module_segments("path"), "::").alias("module"))


@_sources("import_segments", _SOURCES + "SELECT path, CAST(ordinal AS INTEGER) AS ordinal, replace(import_path, '::', '/') AS segments FROM imports")
def _(files):
    return extract.imports(files).select("path", "ordinal", F.array_join(paths.import_segments("import_path"), "/").alias("segments"))


@_sources("items_in_order", _SOURCES + "SELECT path, ordinal, item_id, kind, name, visibility, vis_scope, CAST(line AS BIGINT) AS line_start FROM items")
def _(files):
    return extract.items(files).select("path", "ordinal", "item_id", "kind", "name", "visibility", "vis_scope", "line_start")


def _edges(name: str, f, sql: str | None = None):
    def run(files):
        files, items, imports = parsed(files)
        return f(files, items, imports)

    _sources(name, sql)(run)


_PREVIOUS = _SOURCES + """, fs AS (SELECT k, n, j, 'file:' || path AS f FROM s), fn AS (SELECT k, 'fn:f' || k || ':' || (3 + has) AS id FROM s)
"""
_edges("resolve_imports", lambda files, items, imports: resolve.Resolver(items, imports).resolve(imports.select("path", F.col("import_path").alias("raw")).distinct()).select("from_path", "raw", "to_item", "is_module"),
       _PREVIOUS + "SELECT substr(f, 6) AS from_path, 'crate::m' || n || '::s' || j || '::f' || j AS raw, fn.id AS to_item, false AS is_module FROM fs JOIN fn ON fn.k = j UNION ALL SELECT substr(f, 6), 'crate::m' || n || '::top' || n, 'fn:top' || n || ':1', false FROM fs")
_edges("rel_import_uses", lambda files, items, imports: relate.import_uses(items, imports).select("from_item", "to_item", "rel_type", "rel_detail", "strength", "context"),
       _PREVIOUS + "SELECT f AS from_item, fn.id AS to_item, 'Uses' AS rel_type, 'import-item' AS rel_detail, CAST(1 AS DOUBLE) AS strength, 'crate::m' || n || '::s' || j || '::f' || j AS context FROM fs JOIN fn ON fn.k = j UNION ALL SELECT f, 'fn:top' || n || ':1', 'Uses', 'import-item', 1.0, 'crate::m' || n || '::top' || n FROM fs")
_edges("rel_path_calls", lambda files, items, imports: relate.path_calls(files, items, imports).select("path", "to_item", "context").distinct(),
       _PREVIOUS + "SELECT substr(f, 6) AS path, fn.id AS to_item, 'crate::m' || n || '::s' || j || '::f' || j AS context FROM fs JOIN fn ON fn.k = j UNION ALL SELECT substr(f, 6), 'fn:top' || n || ':1', 'super::top' || n FROM fs WHERE j IS NULL")
_edges("rel_simple_calls", lambda files, items, imports: relate.simple_calls(files, items).select("path", "to_item", "context").distinct(),
       _PREVIOUS + "SELECT substr(f, 6) AS path, fn.id AS to_item, 'f' || j AS context FROM fs JOIN fn ON fn.k = j UNION ALL SELECT substr(f, 6), 'fn:top' || n || ':1', 'top' || n FROM fs")
_edges("rel_calls_dedup", lambda files, items, imports: relate.calls(files, items, imports).select("from_item", "to_item", "rel_detail", "strength", "context"),
       _PREVIOUS + "SELECT f AS from_item, fn.id AS to_item, 'path' AS rel_detail, CAST(0.7 AS DOUBLE) AS strength, 'crate::m' || n || '::s' || j || '::f' || j AS context FROM fs JOIN fn ON fn.k = j UNION ALL SELECT f, 'fn:top' || n || ':1', CASE WHEN j IS NULL THEN 'path' ELSE 'heuristic' END, CASE WHEN j IS NULL THEN 0.7 ELSE 0.5 END, CASE WHEN j IS NULL THEN 'super::top' || n ELSE 'top' || n END FROM fs")


_BUILT = """SELECT 'src/lib.rs' AS src, path AS dst FROM m
UNION ALL SELECT m.path, s.path FROM s JOIN m USING (n)
UNION ALL SELECT path, 'src/m' || n || '/s' || j || '.rs' FROM s, (VALUES ('Uses'), ('Calls')) WHERE j IS NOT NULL
UNION ALL SELECT path, 'src/m' || n || '/mod.rs' FROM s, (VALUES ('Uses'), ('Calls'))"""


@_sources("build_hubs", _SOURCES + _degree_sql(_BUILT, "SELECT path AS key FROM src", "path", "total", 10))
def _(files):
    return queries.hubs(build(files))


@_query("visibility_parse", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Private' WHEN 1 THEN 'Public' WHEN 2 THEN 'PubCrate' WHEN 3 THEN 'PubSuper' WHEN 4 THEN 'PubIn' ELSE 'Private' END AS visibility, CASE p_partkey % 6 WHEN 4 THEN 'in b' || p_partkey END AS scope FROM part")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    texts = F.array(F.lit(""), F.lit("pub "), F.lit("pub(crate) "), F.lit("pub(super)\t"), F.concat(F.lit("pub(in b"), "p_partkey", F.lit(") ")), F.lit("pub() "))
    t = F.element_at(texts, (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", extract.visibility(t).alias("visibility"), extract.visibility_scope(t).alias("scope"))


@_query("dot_nodes", _TRADE + """SELECT '  "' || item_id || '" [label="Module ' || name || '", fillcolor="#e3f2fd", shape="folder", URL="item://' || item_id || '", tooltip="' || path || ' 1"];' AS line FROM items WHERE kind = 'Module'""")
def _(spark, sf_dir):
    return dot.node_lines(adapters.trade_graph(spark, sf_dir).items.filter("kind = 'Module'")).select("line")


@_query("dot_edges", _TRADE + """SELECT '  "' || from_item || '" -> "' || to_item || '" [label="' || CASE rel_type WHEN 'Contains' THEN 'contains:' ELSE 'calls:' END || rel_detail || '", color="' || CASE rel_type WHEN 'Contains' THEN '#9e9e9e", style="dotted", penwidth=1];' ELSE '#e53935", style="solid", penwidth=0.8];' END AS line FROM rel WHERE rel_type IN ('Contains', 'Calls')""")
def _(spark, sf_dir):
    g = adapters.trade_graph(spark, sf_dir)
    return dot.edge_lines(g.relationships.filter("rel_type IN ('Contains', 'Calls')")).select("line")


@_query("cache_diff", "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 10 = 0 THEN 'new' WHEN o_orderkey % 10 = 1 THEN 'changed' WHEN o_orderkey % 10 = 2 THEN 'gone' ELSE 'same' END AS state FROM orders")
def _(spark, sf_dir):
    """A second scan of orders as files: some are new, some have another length, some have vanished."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.cast("string").alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.lit(10).cast("bigint").alias("len"), (k % 10).alias("m"))
    before = o.filter("m <> 0").drop("m")
    now = o.filter("m <> 2").withColumn("len", F.when(F.col("m") == 1, 11).otherwise(F.col("len"))).drop("m")
    return cache.diff(before, now).select("path", "state")
