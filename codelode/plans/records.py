"""Queries over parse records and texts: files, cards, units, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.common import current_records, table
from codelode.functions import text as T
from codelode.operators import cards, files, search, snapshot, tables

_COLUMNS = "ir_version language content_hash byte_len line_count metrics docstring symbols calls imports diagnostics retrieval_card symbol_cards".split()


def current(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_records(table(s, d, "file_parse"), *(columns or _COLUMNS))


def texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("source = 'repo_file' AND path IS NOT NULL").select("repo", "path", "text")


def _size_gate(s: SparkSession, d: str) -> DataFrame:
    kept, skipped = files.split_by_size(current(s, d, "byte_len", "symbols"), 2000)
    good = kept.select("repo", "path", T.language_of_path(F.col("path")).alias("language"), F.size(F.coalesce("symbols", F.array())).cast("bigint").alias("n_symbols"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("message"))
    return good.unionByName(files.skipped_rows(skipped, 2000))


QUERIES = {
    "size_gate": _size_gate,
    "language_filter": lambda s, d: files.of_languages(current(s, d, "language"), ["ts", "PY ", "cobol"]).select("repo", "path", F.col("language_by_path").alias("by_path"), T.language_name(F.col("language")).alias("by_record")),
    "repo_totals": lambda s, d: files.totals(current(s, d, "symbols", "calls")),
    "check_status": lambda s, d: tables.diagnostics(current(s, d, "diagnostics")).groupBy("repo").agg(F.count_if(F.col("severity") == "Error").alias("n_errors"), F.count_if(F.col("severity") == "Warning").alias("n_warnings")).withColumn("failed", F.col("n_errors") > 0),
    "file_card": lambda s, d: cards.file_cards(current(s, d)),
    "symbol_card": lambda s, d: cards.symbol_cards(current(s, d, "symbols", "calls")),
    "call_histogram": lambda s, d: current(s, d, "calls").select("repo", "path", F.explode(cards.call_histogram(F.coalesce("calls", F.array()))).alias("h")).select("repo", "path", "h.name", "h.n"),
    "noise_filter": lambda s, d: tables.calls(current(s, d, "calls")).where(~T.is_noise(F.col("callee_name"))).select("repo", "path", "call_ord", "callee_name"),
    "bare_names": lambda s, d: tables.calls(current(s, d, "calls")).select("repo", "path", "call_ord", T.bare_name(F.col("callee_name")).alias("bare"), T.last_segment(F.col("callee_name")).alias("last"), T.module_prefix(F.col("callee_name")).alias("prefix")),
    "tokenize": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(T.tokenize("text"), " ").alias("words")),
    "norm_query": lambda s, d: table(s, d, "eval_items").select("item_id", T.norm_query("query").alias("norm"), T.est_tokens("text").alias("tokens")),
    "normalize_path": lambda s, d: table(s, d, "change_events").where("path IS NOT NULL").select("arrival_no", T.normalized_path(F.concat_ws("/", F.lit("a/../src"), "path")).alias("normal")),
    "units_terms": lambda s, d: search.units(current(s, d)).select("repo", "path", "line", "kind", "name", F.array_join("terms", " ").alias("words"), "est_tokens"),
    "line_metrics": lambda s, d: files.line_counts(texts(s, d)),
    "content_sizes": lambda s, d: files.sizes(texts(s, d)),
    "caps_truncate": lambda s, d: files.capped(current(s, d, "symbols", "calls", "imports", "diagnostics"), 3, 10, 2, 2).select("repo", "path", F.size("symbols").alias("n_symbols"), F.size("calls").alias("n_calls"), F.size("imports").alias("n_imports"), F.array_join(F.transform("diagnostics", lambda x: x["message"]), "; ").alias("said")),
    "module_docs": lambda s, d: files.module_docs(texts(s, d)),
    "validate_schema": lambda s, d: files.invalid(current(s, d)),
    "fingerprints": lambda s, d: files.fingerprints(current(s, d, "calls", "imports")),
    "import_sets": lambda s, d: current(s, d, "imports").select("repo", "path", F.array_join(F.array_sort(F.array_distinct(F.transform("imports", lambda i: i["target_module"]))), ", ").alias("modules")),
    "snapshot_entries": lambda s, d: snapshot.entries(current(s, d, "symbols", "language", "line_count")),
    "snapshot_budget": lambda s, d: snapshot.allocated(snapshot.entries(current(s, d, "symbols", "language", "line_count")), 500).select("repo", F.posexplode("states").alias("k", "state")).groupBy("repo", "state").agg(F.count(F.lit(1)).alias("n")),
    "snapshot_render": lambda s, d: snapshot.rendered(current(s, d, "symbols", "language", "line_count"), 500),
    "source_fingerprints": lambda s, d: files.source_fingerprints(texts(s, d), "tool 1", "core 0.1"),
    "json_envelope": lambda s, d: table(s, d, "search_hits").where("score > 0 AND NOT isnan(score)").groupBy("item_id").agg(F.sum("tokens_est").alias("tokens_est"), F.count(F.lit(1)).alias("n"), F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("hit_id", "path", "line"))).alias("results"))).alias("envelope")).drop("envelope"),
    "ir_summary": lambda s, d: current(s, d, "symbols", "diagnostics", "language").groupBy(T.language_name(F.col("language")).alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.size(F.coalesce("symbols", F.array()))).alias("n_symbols"), F.count_if(F.size(F.coalesce("diagnostics", F.array())) > 0).alias("n_diagnosed")),
}

CUR = "cur AS (SELECT * FROM file_parse WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY parsed_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1)"
SYM = "sym AS (SELECT repo, path, k - 1 AS sym_ord, unnest(s) FROM (SELECT repo, path, generate_subscripts(symbols, 1) AS k, unnest(symbols) AS s FROM cur) WHERE s IS NOT NULL)"
CALL = "call AS (SELECT repo, path, k - 1 AS call_ord, unnest(c) FROM (SELECT repo, path, generate_subscripts(calls, 1) AS k, unnest(calls) AS c FROM cur) WHERE c IS NOT NULL)"
_BY_PATH = "CASE WHEN suffix(path, '.rs') THEN 'Rust' WHEN regexp_matches(path, '\\.tsx?$') THEN 'TypeScript' WHEN regexp_matches(path, '\\.([mc]?js|jsx)$') THEN 'JavaScript' WHEN regexp_matches(path, '\\.pyi?$') THEN 'Python' END"
_BY_NAME = "CASE WHEN lower(trim(language)) IN ('rust', 'rs') THEN 'Rust' WHEN lower(trim(language)) IN ('typescript', 'ts') THEN 'TypeScript' WHEN lower(trim(language)) IN ('javascript', 'js') THEN 'JavaScript' WHEN lower(trim(language)) IN ('python', 'py') THEN 'Python' END"
_NOISE = "(" + ", ".join(f"'{n}'" for n in T.NOISE) + ")"
_LAST = "list_extract(string_split({}, '::'), -1)"
_DOCS = "doc AS (SELECT repo, path, text FROM documents WHERE source = 'repo_file' AND path IS NOT NULL AND text IS NOT NULL)"
_HISTOGRAM = f"hist AS (SELECT repo, path, {_LAST.format('callee_name')} AS name, count(*) AS n FROM call WHERE {_LAST.format('callee_name')} NOT IN {_NOISE} GROUP BY ALL)"
_WORDS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}}\p{{Lu}})(\p{{Ll}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: lower(w)), lambda w: w <> '')"
UNITS = rf"""
whole AS (SELECT repo, path, k, s, symbol_cards[k] AS card FROM (SELECT repo, path, symbol_cards, generate_subscripts(symbols, 1) AS k, unnest(symbols) AS s FROM cur)),
of_symbols AS (SELECT repo, path, s.start_line AS line, s.kind, s.qualified_name AS name, {_WORDS.format("concat_ws(' ', s.qualified_name, s.signature, s.docstring, card.text)")} AS terms, coalesce(card.est_tokens, 0) AS est_tokens, coalesce(card.text, '') AS card FROM whole),
imported AS (SELECT repo, path, flatten(list(words)) AS terms FROM (SELECT repo, path, {_WORDS.format("concat_ws(' ', i.import_name, i.target_module)")} AS words FROM (SELECT repo, path, unnest(imports) AS i FROM cur)) GROUP BY ALL),
by_file AS (SELECT repo, path, flatten(list(terms)) AS terms FROM of_symbols GROUP BY ALL),
of_files AS (SELECT c.repo, c.path, 0 AS line, 'file' AS kind, c.path AS name,
  list_sort(list_distinct(list_concat({_WORDS.format("concat_ws(' ', c.retrieval_card.text, c.docstring)")}, coalesce(i.terms, []), coalesce(b.terms, [])))) AS terms, coalesce(c.retrieval_card.est_tokens, 0) AS est_tokens, coalesce(c.retrieval_card.text, '') AS card
  FROM cur c LEFT JOIN imported i ON c.repo IS NOT DISTINCT FROM i.repo AND c.path = i.path LEFT JOIN by_file b ON c.repo IS NOT DISTINCT FROM b.repo AND c.path = b.path),
unit AS (SELECT * FROM of_files UNION ALL SELECT * FROM of_symbols)"""
_ENTRIES = f"""
names AS (SELECT repo, path, list(name ORDER BY sym_ord) AS names FROM sym WHERE NOT coalesce(is_test, false) AND name <> '' GROUP BY ALL),
entry AS (SELECT c.repo, c.path, coalesce(line_count, 0) AS line_count, coalesce(len(names), 0) AS n_symbols, c.path || ' ' || coalesce(language, '') || ' ' || coalesce(line_count, 0) || 'L' AS bare_line,
  c.path || ' ' || coalesce(language, '') || ' ' || coalesce(line_count, 0) || 'L' || CASE WHEN len(names) > 0 THEN '  ' || array_to_string(names[1:12], ', ') || CASE WHEN len(names) > 12 THEN ' +' || (len(names) - 12) ELSE '' END ELSE '' END AS full_line
  FROM cur c LEFT JOIN names n ON c.repo IS NOT DISTINCT FROM n.repo AND c.path = n.path)"""

ORACLE = {
    "source_fingerprints": """WITH one AS (SELECT repo, sha256(path)[1:2] AS part, path, sha256(coalesce(text, '')) AS h FROM documents WHERE source = 'repo_file' AND path IS NOT NULL),
      parts AS (SELECT repo, part, sha256(string_agg(path || chr(31) || h, chr(30) ORDER BY path, h)) AS h FROM one GROUP BY ALL) SELECT repo, sha256('tool 1' || chr(29) || 'core 0.1' || chr(29) || string_agg(part || chr(31) || h, chr(30) ORDER BY part))[1:16] AS fingerprint FROM parts GROUP BY repo""",
    "size_gate": f"WITH {CUR} SELECT repo, path, CASE WHEN coalesce(byte_len, 0) <= 2000 THEN {_BY_PATH} ELSE 'unknown' END AS language, CASE WHEN coalesce(byte_len, 0) <= 2000 THEN coalesce(len(symbols), 0) ELSE 0 END AS n_symbols, CASE WHEN byte_len > 2000 THEN 'Warning' END AS severity, CASE WHEN byte_len > 2000 THEN 'file skipped: ' || byte_len || ' bytes exceeds 2000' END AS message FROM cur",
    "language_filter": f"WITH {CUR} SELECT repo, path, {_BY_PATH} AS by_path, {_BY_NAME} AS by_record FROM cur WHERE {_BY_PATH} IN ('TypeScript', 'Python')",
    "repo_totals": f"WITH {CUR} SELECT repo, count(*) AS n_files, sum(coalesce(len(symbols), 0))::BIGINT AS n_symbols, sum(coalesce(len(calls), 0))::BIGINT AS n_calls FROM cur GROUP BY repo",
    "check_status": f"WITH {CUR} SELECT repo, count(*) FILTER (x.severity = 'Error') AS n_errors, count(*) FILTER (x.severity = 'Warning') AS n_warnings, count(*) FILTER (x.severity = 'Error') > 0 AS failed FROM (SELECT repo, unnest(diagnostics) AS x FROM cur) WHERE x IS NOT NULL GROUP BY repo",
    "file_card": rf"""WITH {CUR}, {SYM}, {CALL}, {_HISTOGRAM},
      imp AS (SELECT repo, path, list_sort(list_distinct(list_transform(imports, lambda i: i.target_module))) AS m FROM cur WHERE len(imports) > 0),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY list_position({T.KIND_ORDER}, kind), qualified_name, sym_ord) AS k, count(*) OVER (PARTITION BY repo, path) AS n FROM sym),
      lines AS (SELECT repo, path, any_value(n) AS n, list('  ' || kind || ' ' || qualified_name || ' L' || start_line || '-' || end_line || coalesce(' sig=' || signature, '') ORDER BY k) FILTER (k <= 40) AS l FROM ranked GROUP BY repo, path),
      pub AS (SELECT repo, path, string_agg(name, ', ' ORDER BY sym_ord) AS p FROM sym WHERE regexp_matches(name, '^\p{{Lu}}') GROUP BY repo, path),
      hr AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY n DESC, name) AS k FROM hist), hl AS (SELECT repo, path, count(*) AS n, string_agg(name || '×' || n, ' ' ORDER BY k) FILTER (k <= 15) AS h FROM hr GROUP BY repo, path),
      all_lines AS (SELECT c.repo, c.path, list_concat(['FILE path=' || c.path || ' lang=' || coalesce(language, '') || ' lines=' || coalesce(line_count, 0) || ' hash=' || coalesce(content_hash, '')[1:8]],
        CASE WHEN m IS NOT NULL THEN ['IMPORTS ' || array_to_string(m[1:24], ', ') || CASE WHEN len(m) > 24 THEN ' (+' || (len(m) - 24) || ' more)' ELSE '' END] ELSE [] END,
        CASE WHEN l.n > 0 THEN list_concat(['SYMBOLS'], l.l, CASE WHEN l.n > 40 THEN ['  (+' || (l.n - 40) || ' more)'] ELSE [] END) ELSE [] END,
        CASE WHEN h.n > 0 THEN list_concat(['CALLS_OUT ' || h.h], CASE WHEN h.n > 15 THEN ['  (+' || (h.n - 15) || ' more)'] ELSE [] END) ELSE [] END,
        CASE WHEN p.p IS NOT NULL THEN ['PUB ' || p.p] ELSE [] END) AS ll
        FROM cur c LEFT JOIN imp USING (repo, path) LEFT JOIN lines l USING (repo, path) LEFT JOIN hl h USING (repo, path) LEFT JOIN pub p USING (repo, path)),
      whole AS (SELECT *, array_to_string(ll, chr(10)) AS t FROM all_lines)
      SELECT repo, path, 1::BIGINT AS card_version, ceil(octet_length(encode(t)) / 4)::BIGINT AS est_tokens, CASE WHEN octet_length(encode(t)) <= 2048 THEN t ELSE
        list_reduce(list_transform(ll, lambda x: {{'t': x, 'f': false}}), lambda a, x: CASE WHEN a.f OR octet_length(encode(a.t)) + octet_length(encode(x.t)) + 1 > 2048 THEN {{'t': a.t, 'f': true}} ELSE {{'t': a.t || chr(10) || x.t, 'f': false}} END).t END AS text FROM whole""",
    "symbol_card": rf"""WITH {CUR}, {SYM}, {CALL},
      mine AS (SELECT s.repo, s.path, s.sym_ord, list_sort(list_distinct(list(c.callee_name))) AS names FROM sym s JOIN call c ON s.repo = c.repo AND s.path = c.path AND s.local_key = c.caller_local_key WHERE {_LAST.format('c.callee_name')} NOT IN {_NOISE} GROUP BY ALL),
      card AS (SELECT s.repo, s.path, s.sym_ord, list_filter(['SYM path=' || s.path || ' qname=' || qualified_name || ' kind=' || kind || ' L' || start_line || '-' || end_line, 'SIG ' || signature, CASE WHEN docstring[1:240] <> '' THEN 'DOC ' || docstring[1:240] END,
        CASE WHEN len(names) > 0 THEN 'CALLS ' || array_to_string(names[1:10], ', ') || CASE WHEN len(names) > 10 THEN ' (+' || (len(names) - 10) || ')' ELSE '' END END], lambda x: x IS NOT NULL) AS ll FROM sym s LEFT JOIN mine m USING (repo, path, sym_ord)),
      whole AS (SELECT *, array_to_string(ll, chr(10)) AS t FROM card),
      cut AS (SELECT repo, path, sym_ord, CASE WHEN octet_length(encode(t)) <= 512 THEN t ELSE
        list_reduce(list_transform(ll, lambda x: {{'t': x, 'f': false}}), lambda a, x: CASE WHEN a.f OR octet_length(encode(a.t)) + octet_length(encode(x.t)) + 1 > 512 THEN {{'t': a.t, 'f': true}} ELSE {{'t': a.t || chr(10) || x.t, 'f': false}} END).t END AS text FROM whole)
      SELECT repo, path, sym_ord, 1::BIGINT AS card_version, ceil(octet_length(encode(text)) / 4)::BIGINT AS est_tokens, text FROM cut""",
    "line_metrics": rf"""WITH {_DOCS}, kinds AS (SELECT repo, path, {_BY_PATH} AS kind, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM doc WHERE text <> ''),
      bare AS (SELECT repo, path, k, kind, trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) AS b FROM kinds),
      turns AS (SELECT *, kind IS DISTINCT FROM 'Python' AND starts_with(b, '/*') AS opens, contains(b, '*/') AS closes FROM bare),
      -- a line is inside a block if the last line before it that opened one (and did not close it) is not followed by a closing line
      marks AS (SELECT *, max(CASE WHEN opens AND NOT closes THEN k END) OVER w AS o, max(CASE WHEN closes THEN k END) OVER w AS c FROM turns WINDOW w AS (PARTITION BY repo, path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      state AS (SELECT *, o IS NOT NULL AND o > coalesce(c, 0) AS inside FROM marks),
      told AS (SELECT repo, path, inside OR opens OR CASE WHEN kind = 'Python' THEN starts_with(b, '#') ELSE starts_with(b, '//') END AS comment, b = '' AND NOT inside AS blank FROM state)
      SELECT d.repo, d.path, count(*) FILTER (NOT comment AND NOT blank) AS code_lines, count(*) FILTER (comment AND NOT blank) AS comment_lines, count(*) FILTER (blank) AS blank_lines, count(t.path) AS total_lines FROM doc d LEFT JOIN told t USING (repo, path) GROUP BY d.repo, d.path""",
    "call_histogram": f"WITH {CUR}, {CALL}, {_HISTOGRAM} SELECT repo, path, name, n FROM hist",
    "noise_filter": f"WITH {CUR}, {CALL} SELECT repo, path, call_ord, callee_name FROM call WHERE {_LAST.format('callee_name')} NOT IN {_NOISE}",
    "bare_names": f"WITH {CUR}, {CALL}, head AS (SELECT *, string_split(callee_name, '(')[1] AS h FROM call) SELECT repo, path, call_ord, CASE WHEN contains(h, '::') THEN nullif({_LAST.format('h')}, '') WHEN contains(h, '.') OR h = '' THEN NULL ELSE h END AS bare, {_LAST.format('callee_name')} AS \"last\", CASE WHEN contains(callee_name, '::') THEN regexp_extract(callee_name, '^(?s:(.*))::', 1) END AS prefix FROM head",
    "tokenize": f"SELECT doc_id, array_to_string({_WORDS.format('text')}, ' ') AS words FROM documents",
    "norm_query": r"SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}_]+'), lambda w: w <> ''), ' ') AS norm, ceil(octet_length(encode(text)) / 4)::BIGINT AS tokens FROM eval_items",
    "normalize_path": "SELECT arrival_no, array_to_string(list_filter(string_split('src/' || path, '/'), lambda p: p NOT IN ('', '.')), '/') AS normal FROM change_events WHERE path IS NOT NULL",
    "units_terms": f"WITH {CUR}, {UNITS} SELECT repo, path, line, kind, name, array_to_string(terms, ' ') AS words, est_tokens FROM unit",
    "content_sizes": f"WITH {_DOCS} SELECT repo, path, octet_length(encode(text)) AS byte_len, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, sha256(text) AS digest FROM doc",
    "validate_schema": f"""WITH {CUR}, {SYM}, {CALL}
      SELECT repo, path, 'version' AS problem FROM cur WHERE NOT coalesce(ir_version BETWEEN 1 AND 5, false)
      UNION ALL SELECT DISTINCT repo, path, 'empty name' FROM sym WHERE coalesce(name, '') = '' OR coalesce(qualified_name, '') = ''
      UNION ALL SELECT DISTINCT repo, path, 'span' FROM sym WHERE end_line < start_line
      UNION ALL SELECT DISTINCT c.repo, c.path, 'unknown caller' FROM call c ANTI JOIN sym s ON c.repo IS NOT DISTINCT FROM s.repo AND c.path = s.path AND c.caller_local_key = s.local_key
      UNION ALL SELECT repo, path, 'cards' FROM cur WHERE coalesce(len(symbols), 0) <> coalesce(len(symbol_cards), 0)""",
    "import_sets": f"WITH {CUR} SELECT repo, path, array_to_string(list_sort(list_distinct(list_transform(imports, lambda i: i.target_module))), ', ') AS modules FROM cur",
    "snapshot_entries": f"WITH {CUR}, {SYM}, {_ENTRIES} SELECT * FROM entry",
    "json_envelope": "SELECT item_id, sum(tokens_est)::BIGINT AS tokens_est, count(*) AS n FROM search_hits WHERE score > 0 AND NOT isnan(score) GROUP BY item_id",
    "ir_summary": f"WITH {CUR} SELECT {_BY_NAME} AS language, count(*) AS n_files, sum(coalesce(len(symbols), 0))::BIGINT AS n_symbols, count(*) FILTER (len(diagnostics) > 0) AS n_diagnosed FROM cur GROUP BY 1",
    "fingerprints": f"""WITH {CUR} SELECT repo, path, sha256(concat_ws(chr(10),
      array_to_string(list_transform(coalesce(calls, []), lambda c: concat_ws('|', c.callee_name, coalesce(c.callee_local_key, '-'), coalesce(c.callee_file, '-'), coalesce(c.callee_external::VARCHAR, '-'))), ';'),
      array_to_string(list_transform(coalesce(imports, []), lambda i: concat_ws('|', i.target_module, coalesce(i.resolved, '-'))), ';'))) AS fingerprint FROM cur""",
    "caps_truncate": f"""WITH {CUR}, n AS (SELECT *, coalesce(len(symbols), 0) AS ns, coalesce(len(calls), 0) AS nc, coalesce(len(imports), 0) AS ni, list_transform(coalesce(diagnostics, []), lambda x: x.message) AS d0 FROM cur),
      a AS (SELECT *, CASE WHEN ns > 3 THEN list_append(d0[1:1], 'symbols truncated: ' || ns || ' exceeds 3') ELSE d0 END AS d1 FROM n),
      b AS (SELECT *, CASE WHEN nc > 10 THEN list_append(d1[1:1], 'calls truncated: ' || nc || ' exceeds 10') ELSE d1 END AS d2 FROM a),
      c AS (SELECT *, CASE WHEN ni > 2 THEN list_append(d2[1:1], 'imports truncated: ' || ni || ' exceeds 2') ELSE d2 END AS d3 FROM b)
      SELECT repo, path, len(symbols[1:3])::INTEGER AS n_symbols, len(calls[1:10])::INTEGER AS n_calls, len(imports[1:2])::INTEGER AS n_imports, array_to_string(list_filter(d3, lambda m: m IS NOT NULL), '; ') AS said FROM c""",
}
