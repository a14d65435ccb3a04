"""Queries that resolve calls and imports and walk the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.common import table, written
from codelode.functions import text as T
from codelode.operators import config, graph, report, resolve, scip, tables
from codelode.plans.records import _BY_NAME, _BY_PATH, CALL, CUR, SYM, current

def _by_language(s: SparkSession, d: str) -> DataFrame:
    rows = current(s, d, "language", "symbols", "calls")
    return rows.withColumn("language", F.coalesce(T.language_name(F.col("language")), T.language_of_path(F.col("path"))))


def _joint(s: SparkSession, d: str) -> DataFrame:
    """All repositories as one, their names in front of the paths: then calls find more names."""
    rows = current(s, d, "symbols", "calls")
    calls = F.transform("calls", lambda c: c.withField("callee_file", F.concat("repo", F.lit("/"), c["callee_file"])))
    return rows.select(F.lit("all").alias("repo"), F.concat("repo", F.lit("/"), "path").alias("path"), "symbols", calls.alias("calls"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.edges(_joint(s, d))


def _flat(pairs: DataFrame) -> DataFrame:
    ends = [F.col(f"{end}.{part}").alias(f"{end}_{short}") for end in ("caller", "callee") for part, short in (("path", "path"), ("sym_ord", "ord"))]
    return pairs.select("repo", *ends, *[c for c in pairs.columns if c in ("call_line", "inferred")])


def _neighbours(callers: bool):  # noqa: ANN202
    def query(s: SparkSession, d: str) -> DataFrame:
        files = _joint(s, d)
        return graph.neighbours(graph.nodes(files), graph.adjacency(graph.edges(files)), _busiest(files, callers), callers)

    return query


def _busiest(files: DataFrame, callers: bool) -> str:
    """The bare name of the nodes with most neighbours."""
    end = "callee" if callers else "caller"
    counts = graph.adjacency(graph.edges(files)).groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    row = graph.nodes(files).join(counts, "node").groupBy("name").agg(F.sum("n").alias("n")).where("name IS NOT NULL").orderBy(F.desc("n"), "name").first()
    return row["name"] if row else ""


def _shortest(s: SparkSession, d: str) -> DataFrame:
    # every level reads the pairs; the three tiers of edges are resolved once
    pairs = written(graph.adjacency(_edges(s, d)), "pairs")
    start = pairs.groupBy("repo").agg(F.min("caller").alias("node"))
    reached = graph.reach(pairs, start, 8)
    return reached.select("repo", F.col("node.path").alias("path"), F.col("node.sym_ord").alias("ord"), "hops")


def _imports(s: SparkSession, d: str) -> DataFrame:
    files = current(s, d, "imports")
    rows = tables.imports(files).where(T.language_of_path(F.col("path")).isin("TypeScript", "JavaScript")).select("repo", "path", "imp_ord", "target_module")
    # specifiers are repeated as paths of the repository's own files, so that some exist
    own = rows.unionByName(files.select("repo", "path", F.lit(-1).cast("bigint").alias("imp_ord"), F.concat(F.lit("./x/../"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+$", "")).alias("target_module")))
    return resolve.probed(resolve.import_candidates(own), files.select("repo", "path")).select("repo", "path", "imp_ord", "target_module", "candidate", "resolved")


def _aliases(s: SparkSession, d: str) -> DataFrame:
    files = current(s, d, "imports")
    dirs = files.select("repo", F.regexp_extract("path", r"^((?:packages|crates|src)/[^/]+)/", 1).alias("dir")).where("dir <> ''").distinct()
    paths = F.create_map(F.lit("./*"), F.array(F.lit("own/*"), F.lit("other/*")), F.lit("@/*"), F.array(F.lit("lib/*")), F.lit("core.chapter"), F.array(F.lit("index")))
    configs = dirs.withColumn("base_url", F.concat("dir", F.lit("/"))).withColumn("paths", paths)
    rows = tables.imports(files).select("repo", "path", "imp_ord", F.regexp_replace("target_module", r"^\./", "@/").alias("target_module"))
    near = resolve.nearest_config(files, configs).select("repo", "path", "dir")
    return resolve.import_candidates(rows, configs).join(near, ["repo", "path"], "left").select("repo", "path", "imp_ord", "target_module", "dir", "candidate")


def occurrences(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and calls of the records in the shape of a compiler's index: definitions at the symbols' lines, references at the calls of unique names."""
    symbols, calls = tables.symbols(current(s, d, "symbols")), tables.calls(current(s, d, "calls"))
    spelled = lambda name: F.regexp_replace(name, "::|\\.", "#")
    key = lambda name: F.concat(F.lit("rust-analyzer cargo x 0.1 m/"), spelled(name), F.lit("()."))
    of = lambda line: F.array(line - 1, F.lit(4).cast("bigint"), F.lit(9).cast("bigint"))
    defs = symbols.where("qualified_name <> ''").select(F.concat_ws("/", "repo", "path").alias("doc"), key(F.col("qualified_name")).alias("symbol"), F.lit(1).cast("bigint").alias("roles"), of(F.col("start_line")).alias("range"))
    refs = calls.where("callee_local_key IS NOT NULL").select(F.concat_ws("/", "repo", "path").alias("doc"), key(F.regexp_replace("callee_name", r"\s", "")).alias("symbol"), F.lit(0).cast("bigint").alias("roles"), of(F.col("line")).alias("range"))
    kinds = symbols.where("qualified_name <> ''").select(key(F.col("qualified_name")).alias("symbol"), F.col("kind"))
    return defs.unionByName(refs), kinds


def _lookup(s: SparkSession, d: str) -> DataFrame:
    """All nodes that the name with most nodes may mean."""
    nodes = graph.nodes(current(s, d, "symbols"))
    top = nodes.where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").first()
    return graph.lookup(nodes, top["name"] if top else "").select("repo", "path", "sym_ord", "qualified_name")


def _path_pairs(s: SparkSession, d: str) -> DataFrame:
    """The edges between neighbours of each file's first symbol within two hops: consecutive pairs of the walked paths."""
    files = current(s, d, "symbols", "calls").where("repo IS NOT NULL")
    pairs = written(graph.adjacency(graph.edges(files)), "pairs")
    start = graph.nodes(files).groupBy("repo").agg(F.min("node").alias("node"))
    rows = report.steps(graph.reach(pairs, start, 2), pairs)
    return rows.select("repo", F.col("node.path").alias("path"), F.col("node.sym_ord").alias("ord"), "step", F.col("caller.path").alias("caller_path"), F.col("callee.path").alias("callee_path"), "call_line")


def _configs(s: SparkSession, d: str) -> DataFrame:
    """Configuration files for the folders of each repository: those with a name of even length inherit from one at the root and have a base of their own, the others declare their own paths."""
    dirs = current(s, d, "imports").select("repo", F.regexp_extract("path", r"^((?:packages|crates|src)/[^/]+)/", 1).alias("dir")).where("dir <> '' AND repo IS NOT NULL").distinct()
    inherits = F.lit('{"extends": ["../../tsconfig.base"], "compilerOptions": {"baseUrl": "src/"}}')
    own = F.lit('{"compilerOptions": {"paths": {"~/*": ["./*", 3], "none": []}}}')
    files = dirs.select("repo", F.concat("dir", F.lit("/tsconfig.json")).alias("path"), F.when(F.length("dir") % 2 == 0, inherits).otherwise(own).alias("text"))
    roots = dirs.select("repo").distinct().select("repo", F.lit("tsconfig.base.json").alias("path"), F.lit('{"compilerOptions": {"baseUrl": "./", "paths": {"@/*": ["lib/*"]}}}').alias("text"))
    return config.effective(files.unionByName(roots)).select("repo", "dir", "base_url", F.to_json("paths").alias("paths"))


QUERIES = {
    "config_effective": _configs,
    "caller_lines": lambda s, d: _neighbours(True)(s, d).select("repo", report.edge_line(True).alias("text")),
    "callee_lines": lambda s, d: _neighbours(False)(s, d).select("repo", report.edge_line(False).alias("text")),
    "path_pairs": _path_pairs,
    "binding_names": lambda s, d: scip.bindings(*occurrences(s, d)).select("file", "line", F.col("column").alias("place"), "callee_qualified_name"),
    "resolve_in_file": lambda s, d: resolve.in_file(_by_language(s, d)),
    "resolve_cross_file": lambda s, d: resolve.across_files(current(s, d, "symbols", "calls")).select("repo", "path", "call_ord", "callee_name", "callee_file", "callee_external"),
    "resolve_links": _imports,
    "nearest_prefix_config": _aliases,
    "edges_three_tier": lambda s, d: _flat(_edges(s, d)),
    "adjacency": lambda s, d: _flat(graph.adjacency(_edges(s, d))),
    "callers": _neighbours(True),
    "callees": _neighbours(False),
    "name_lookup_ambiguous": _lookup,
    "shortest_path": _shortest,
    "scip_unique_def_join": lambda s, d: scip.bindings(*occurrences(s, d)).select("file", "line", "symbol", "callee_file", "callee_line", "dispatch"),
    "scip_span_align": lambda s, d: scip.aligned(scip.bindings(*occurrences(s, d)), tables.symbols(current(s, d, "symbols")).withColumn("path", F.concat_ws("/", "repo", "path"))).groupBy("callee_file").agg(F.count(F.lit(1)).alias("n")),
    "uniqueness_counts": lambda s, d: graph.unique_wins(graph.nodes(current(s, d, "symbols")), ["repo", "name"]).select("repo", "name", F.col("node.path").alias("path"), F.col("node.sym_ord").alias("ord")),
}

_EDGES = rf"""
local AS (SELECT repo, path, local_key, min(sym_ord) AS ord FROM sym GROUP BY ALL),
named AS (SELECT repo, path, qualified_name, min(sym_ord) AS ord FROM sym GROUP BY ALL),
here AS (SELECT repo, path, name, min(sym_ord) AS ord FROM sym GROUP BY ALL HAVING count(*) = 1),
anywhere AS (SELECT repo, name, min(path) AS path, min(sym_ord) AS ord FROM sym GROUP BY ALL HAVING count(*) = 1),
made AS (SELECT c.*, l.ord AS caller_ord, string_split(callee_name, '(')[1] AS h, list_extract(string_split(callee_name, '::'), -1) AS lst FROM call c JOIN local l ON c.repo = l.repo AND c.path = l.path AND c.caller_local_key = l.local_key),
wanted AS (SELECT *, CASE WHEN callee_local_key IS NULL AND callee_file IS NULL THEN CASE WHEN contains(h, '::') THEN nullif(list_extract(string_split(h, '::'), -1), '') WHEN contains(h, '.') OR h = '' THEN NULL ELSE h END END AS bare FROM made),
edge AS (
  SELECT w.repo, w.path AS caller_path, w.caller_ord, w.path AS callee_path, l.ord AS callee_ord, w.line AS call_line, false AS inferred, w.call_ord FROM wanted w JOIN local l ON w.repo = l.repo AND w.path = l.path AND w.callee_local_key = l.local_key
  UNION ALL
  SELECT w.repo, w.path, w.caller_ord, w.callee_file, coalesce(n.ord, h.ord), w.line, false, w.call_ord FROM wanted w LEFT JOIN named n ON w.repo = n.repo AND w.callee_file = n.path AND w.callee_name = n.qualified_name
    LEFT JOIN here h ON w.repo = h.repo AND w.callee_file = h.path AND w.lst = h.name WHERE w.callee_local_key IS NULL AND w.callee_file IS NOT NULL AND coalesce(n.ord, h.ord) IS NOT NULL
  UNION ALL
  SELECT w.repo, w.path, w.caller_ord, a.path, a.ord, w.line, true, w.call_ord FROM wanted w JOIN anywhere a ON w.repo = a.repo AND w.bare = a.name),
pair AS (SELECT repo, caller_path, caller_ord, callee_path, callee_ord, min_by(call_line, call_ord) AS call_line, min_by(inferred, call_ord) AS inferred FROM edge GROUP BY ALL)"""
_COMMON = "common AS (SELECT name FROM pair p JOIN sym s ON p.repo = s.repo AND p.{0}_path = s.path AND p.{0}_ord = s.sym_ord WHERE name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), own AS (SELECT s.* FROM sym s, common c WHERE s.name = c.name OR s.qualified_name = c.name)"
_JOINT = "cur0 AS " + CUR.split(" AS ", 1)[1] + ", cur AS (SELECT 'all' AS repo, repo || '/' || path AS path, symbols, calls, repo AS repo0 FROM cur0)"
_JOINT_CALL = "call AS (SELECT * REPLACE (CASE WHEN callee_file IS NOT NULL THEN repo0 || '/' || callee_file END AS callee_file) FROM (SELECT repo, path, repo0, k - 1 AS call_ord, unnest(c) FROM (SELECT repo, path, repo0, generate_subscripts(calls, 1) AS k, unnest(calls) AS c FROM cur) WHERE c IS NOT NULL))"
_SCIP = r"""
occ AS (SELECT repo || '/' || path AS doc, 'rust-analyzer cargo x 0.1 m/' || regexp_replace(qualified_name, '::|\.', '#', 'g') || '().' AS symbol, 1 AS roles, start_line AS line FROM sym WHERE qualified_name <> ''
  UNION ALL SELECT repo || '/' || path, 'rust-analyzer cargo x 0.1 m/' || regexp_replace(regexp_replace(callee_name, '\s', '', 'g'), '::|\.', '#', 'g') || '().', 0, line FROM call WHERE callee_local_key IS NOT NULL),
kinds AS (SELECT DISTINCT 'rust-analyzer cargo x 0.1 m/' || regexp_replace(qualified_name, '::|\.', '#', 'g') || '().' AS symbol FROM sym WHERE qualified_name <> '' AND kind IN ('Method', 'StaticMethod', 'TraitMethod', 'Function', 'Macro')),
defined AS (SELECT symbol, min(doc) AS callee_file, min(line) AS callee_line FROM occ WHERE roles = 1 GROUP BY symbol HAVING count(DISTINCT (doc, line)) = 1),
bound AS (SELECT DISTINCT o.doc AS file, o.line, symbol, callee_file, callee_line, 'static' AS dispatch FROM occ o JOIN defined USING (symbol) SEMI JOIN kinds USING (symbol) WHERE roles = 0)"""
_GRAPH = f"WITH {_JOINT}, {SYM}, {_JOINT_CALL}, {_EDGES}"
_HEADS = f"WITH {CUR}, {SYM}, {CALL}, "

_PROBE = "CASE WHEN contains(list_extract(string_split(candidate, '/'), -1), '.') THEN [''] ELSE ['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'] END"
_NORMAL = r"""list_reduce(string_split(regexp_replace(path, '/?[^/]*$', '') || '/' || target_module, '/'), lambda a, p: CASE WHEN p IN ('', '.') THEN a WHEN p = '..' THEN CASE WHEN contains(a, '/') THEN regexp_replace(a, '/[^/]*$', '') ELSE '' END WHEN a = '' THEN p ELSE a || '/' || p END, '')"""
_BY_EXT = r"regexp_matches(path, '\.(tsx?|[mc]?js|jsx)$')"

_BINDINGS = f"""{_HEADS}{_SCIP}, named AS (SELECT *, string_split(replace(regexp_extract(symbol, '([^/]*)$', 1), '().', ''), '#') AS parts FROM bound)
  SELECT file, line, 4::BIGINT AS place, CASE WHEN len(parts) > 1 THEN parts[-2] || '::' || parts[-1] ELSE parts[-1] END AS callee_qualified_name FROM named"""

ORACLE = {
    "resolve_in_file": rf"""WITH {CUR}, {SYM}, {CALL}, lang AS (SELECT repo, path, coalesce({_BY_NAME}, {_BY_PATH}) AS language FROM cur),
      by_name AS (SELECT repo, path, name AS k, min_by(local_key, sym_ord) AS v FROM sym WHERE name IS NOT NULL GROUP BY ALL), by_qual AS (SELECT repo, path, qualified_name AS k, min_by(local_key, sym_ord) AS v FROM sym WHERE qualified_name IS NOT NULL GROUP BY ALL),
      who AS (SELECT repo, path, local_key, min_by(qualified_name, sym_ord) AS caller_name FROM sym GROUP BY ALL),
      c AS (SELECT call.*, language, caller_name, contains(callee_name, '::') AS scoped FROM call JOIN lang USING (repo, path) LEFT JOIN who ON call.repo = who.repo AND call.path = who.path AND call.caller_local_key = who.local_key),
      k AS (SELECT *, CASE WHEN language = 'Rust' AND NOT scoped THEN concat_ws('::', CASE WHEN contains(caller_name, '::') THEN regexp_extract(caller_name, '^(?s:(.*))::', 1) END, callee_name) ELSE callee_name END AS kq,
        CASE WHEN language = 'JavaScript' AND contains(callee_name, '.') THEN string_split(callee_name, '.')[1] END AS kf FROM c)
      SELECT k.repo, k.path, call_ord, callee_name, CASE WHEN language = 'Rust' THEN coalesce(q.v, CASE WHEN NOT scoped AND NOT contains(callee_name, '::') THEN r.v END) ELSE coalesce(n.v, q.v, f.v) END AS local_key,
        coalesce(CASE WHEN language = 'Rust' THEN q.v IS NULL ELSE coalesce(n.v, q.v, f.v) IS NULL END AND scoped AND language IN ('Rust', 'TypeScript'), false) AS external
      FROM k LEFT JOIN by_name n ON k.repo = n.repo AND k.path = n.path AND callee_name = n.k AND language <> 'Rust' LEFT JOIN by_qual q ON k.repo = q.repo AND k.path = q.path AND kq = q.k
        LEFT JOIN by_qual r ON k.repo = r.repo AND k.path = r.path AND callee_name = r.k AND NOT contains(r.k, '::') LEFT JOIN by_name f ON k.repo = f.repo AND k.path = f.path AND kf = f.k""",
    "resolve_links": rf"""WITH {CUR}, imp AS (SELECT repo, path, k - 1 AS imp_ord, i.target_module FROM (SELECT repo, path, generate_subscripts(imports, 1) AS k, unnest(imports) AS i FROM cur) WHERE i IS NOT NULL AND {_BY_EXT}
        UNION ALL SELECT repo, path, -1, './x/../' || regexp_replace(list_extract(string_split(path, '/'), -1), '\.\w+$', '') FROM cur),
      c AS (SELECT *, CASE WHEN starts_with(target_module, './') OR starts_with(target_module, '../') THEN {_NORMAL} END AS candidate FROM imp),
      t AS (SELECT repo, candidate, generate_subscripts(p, 1) AS k, unnest(p) AS tail FROM (SELECT DISTINCT repo, candidate, {_PROBE} AS p FROM c WHERE candidate IS NOT NULL)),
      hit AS (SELECT t.repo, candidate, min_by(candidate || tail, k) AS resolved FROM t SEMI JOIN cur ON t.repo = cur.repo AND candidate || tail = cur.path GROUP BY ALL)
      SELECT c.repo, c.path, imp_ord, target_module, c.candidate, resolved FROM c LEFT JOIN hit ON c.repo = hit.repo AND c.candidate = hit.candidate""",
    "nearest_prefix_config": rf"""WITH {CUR}, conf AS (SELECT DISTINCT repo, regexp_extract(path, '^((?:packages|crates|src)/[^/]+)/', 1) AS dir FROM cur WHERE regexp_matches(path, '^(?:packages|crates|src)/[^/]+/')),
      imp AS (SELECT repo, path, k - 1 AS imp_ord, regexp_replace(i.target_module, '^\./', '@/') AS target_module FROM (SELECT repo, path, generate_subscripts(imports, 1) AS k, unnest(imports) AS i FROM cur) WHERE i IS NOT NULL),
      near AS (SELECT i.*, (SELECT max_by(dir, length(dir)) FROM conf c WHERE c.repo = i.repo AND starts_with(i.path, c.dir || '/')) AS dir FROM imp i)
      SELECT *, CASE WHEN starts_with(target_module, '../') THEN {_NORMAL} WHEN dir IS NULL THEN NULL WHEN starts_with(target_module, '@/') THEN dir || '/lib/' || substr(target_module, 3) WHEN target_module = 'core.chapter' THEN dir || '/index' END AS candidate FROM near""",
    "resolve_cross_file": f"""WITH {CUR}, {SYM}, {CALL}, index AS (SELECT repo, qualified_name, min(path) AS found FROM sym WHERE contains(qualified_name, '::') GROUP BY ALL)
      SELECT c.repo, c.path, call_ord, callee_name, CASE WHEN o AND found <> c.path THEN found ELSE callee_file END AS callee_file, CASE WHEN o AND found <> c.path THEN false WHEN o AND found IS NULL THEN true ELSE callee_external END AS callee_external
      FROM (SELECT *, callee_local_key IS NULL AND callee_file IS NULL AND contains(callee_name, '::') AS o FROM call WHERE callee_name IS NOT NULL UNION ALL SELECT *, false FROM call WHERE callee_name IS NULL) c LEFT JOIN index i ON c.repo = i.repo AND c.callee_name = i.qualified_name""",
    "edges_three_tier": f"{_GRAPH} SELECT repo, caller_path, caller_ord, callee_path, callee_ord, call_line, inferred FROM edge",
    "adjacency": f"{_GRAPH} SELECT * FROM pair",
    "callers": f"{_GRAPH}, {_COMMON.format('callee')} SELECT p.repo, callee_path AS of_path, o.qualified_name AS \"of\", caller_path AS path, s.qualified_name, call_line AS line, inferred FROM pair p JOIN own o ON p.repo = o.repo AND p.callee_path = o.path AND p.callee_ord = o.sym_ord JOIN sym s ON p.repo = s.repo AND p.caller_path = s.path AND p.caller_ord = s.sym_ord",
    "callees": f"{_GRAPH}, {_COMMON.format('caller')} SELECT p.repo, caller_path AS of_path, o.qualified_name AS \"of\", callee_path AS path, s.qualified_name, call_line AS line, inferred FROM pair p JOIN own o ON p.repo = o.repo AND p.caller_path = o.path AND p.caller_ord = o.sym_ord JOIN sym s ON p.repo = s.repo AND p.callee_path = s.path AND p.callee_ord = s.sym_ord",
    "config_effective": f"""WITH {CUR}, dirs AS (SELECT DISTINCT repo, regexp_extract(path, '^((?:packages|crates|src)/[^/]+)/', 1) AS dir FROM cur WHERE repo IS NOT NULL) SELECT repo, dir, CASE WHEN length(dir) % 2 = 0 THEN dir || '/src' ELSE dir END AS base_url,
      CASE WHEN length(dir) % 2 = 0 THEN '{{"@/*":["lib/*"]}}' ELSE '{{"~/*":["./*"]}}' END AS paths FROM dirs WHERE dir <> ''""",
    "binding_names": _BINDINGS,
    "path_pairs": f"""WITH {CUR}, {SYM}, {CALL}, {_EDGES}, start AS (SELECT repo, min(struct_pack(path := path, ord := sym_ord)) AS node FROM sym WHERE repo IS NOT NULL GROUP BY repo),
      link AS (SELECT repo, struct_pack(path := caller_path, ord := caller_ord) AS a, struct_pack(path := callee_path, ord := callee_ord) AS b, call_line FROM pair),
      one AS (SELECT s.repo, s.node, l.b, l.call_line FROM start s JOIN link l ON s.repo = l.repo AND s.node = l.a WHERE l.b <> s.node),
      two AS (SELECT l.repo, l.b AS c, min(o.b) AS via, any_value(o.node) AS node FROM one o JOIN link l ON o.repo = l.repo AND o.b = l.a WHERE l.b <> o.node AND NOT EXISTS (SELECT 1 FROM one x WHERE x.repo = l.repo AND x.b = l.b) GROUP BY ALL)
      SELECT repo, b.path AS path, b.ord AS ord, 1::BIGINT AS step, node.path AS caller_path, b.path AS callee_path, call_line FROM one
      UNION ALL SELECT t.repo, c.path, c.ord, 1, t.node.path, via.path, o.call_line FROM two t JOIN one o ON t.repo = o.repo AND t.via = o.b
      UNION ALL SELECT t.repo, c.path, c.ord, 2, via.path, c.path, l.call_line FROM two t JOIN link l ON t.repo = l.repo AND t.via = l.a AND t.c = l.b""",
    "name_lookup_ambiguous": f"WITH {CUR}, {SYM}, top AS (SELECT name FROM sym WHERE name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 1) SELECT s.repo, s.path, s.sym_ord, s.qualified_name FROM sym s, top t WHERE s.name = t.name OR s.qualified_name = t.name",
    "shortest_path": f"""WITH RECURSIVE {_JOINT}, {SYM}, {_JOINT_CALL}, {_EDGES}, start AS (SELECT repo, min((caller_path, caller_ord)) AS n FROM pair GROUP BY repo),
      walk AS (SELECT repo, n[1] AS path, n[2] AS ord, 0 AS hops FROM start UNION SELECT w.repo, p.callee_path, p.callee_ord, hops + 1 FROM walk w JOIN pair p ON w.repo = p.repo AND w.path = p.caller_path AND w.ord = p.caller_ord WHERE hops < 8)
      SELECT repo, path, ord, min(hops)::BIGINT AS hops FROM walk GROUP BY repo, path, ord""",
    "uniqueness_counts": f"WITH {CUR}, {SYM} SELECT repo, name, min(path) AS path, min(sym_ord) AS ord FROM sym GROUP BY repo, name HAVING count(*) = 1",
    "scip_unique_def_join": f"{_HEADS}{_SCIP} SELECT file, line, symbol, callee_file, callee_line, dispatch FROM bound",
    "scip_span_align": f"{_HEADS}{_SCIP} SELECT callee_file, count(*) AS n FROM bound b WHERE EXISTS (SELECT 1 FROM sym s WHERE s.repo || '/' || s.path = b.callee_file AND b.callee_line BETWEEN s.start_line AND s.end_line) GROUP BY callee_file",
}
ORACLE["caller_lines"] = f"""SELECT repo, '  ' || path || ':' || coalesce(line::VARCHAR, '') || '  ' || qualified_name || CASE WHEN inferred THEN '  (inferred)' ELSE '' END AS text FROM ({ORACLE["callers"]})"""
ORACLE["callee_lines"] = f"""SELECT repo, '  ' || of_path || ':' || coalesce(line::VARCHAR, '') || '  ' || "of" || ' → ' || qualified_name || CASE WHEN inferred THEN '  (inferred)' ELSE '' END AS text FROM ({ORACLE["callees"]})"""
