"""Queries on ranked search, its evaluation, the judge and what is learned from usage; change detection between two states of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.common import made, shared_dir, table, written
from codelode.functions import text as T
from codelode.operators import change_log, evaluate, files, gate, learn, report, search
from codelode.plans.records import CUR, UNITS, current, texts
from codelode.sources import jsonl

_QUERY = "schedule sealed replica"
_LEXICON = (["replica", "sealed"], ["path", "kind"])


def _units(s: SparkSession, d: str) -> DataFrame:
    # search reads the units twice (statistics, scores); building them is the dear part
    return written(search.units(current(s, d)), "units")


def _unit_table(s: SparkSession, d: str) -> DataFrame:
    """The delivered units, each once, in the form of search units."""
    rows = table(s, d, "search_units").where("unit_id IS NOT NULL")
    once = rows.groupBy("unit_id").agg(F.min(F.struct("repo", "path", "line", "kind", "name", "content_hash", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("target", F.lit("")).alias("target"), F.coalesce("card", F.lit("")).alias("card"), "est_tokens")).alias("u"))
    return once.select("u.*")


def _hits(s: SparkSession, d: str) -> DataFrame:
    """Stored hits: each row once, scores that are numbers and not negative."""
    rows = table(s, d, "search_hits").where("score IS NOT NULL AND NOT isnan(score) AND score >= 0 AND path IS NOT NULL")
    return rows.groupBy("item_id", "path", "line", "kind", "name", "score", "content_hash", "card").agg(F.min("hit_id").alias("hit_id"), F.min("tokens_est").alias("tokens_est"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "path", "name", "line", "hit_id"))
    return _hits(s, d).withColumn("place", place.cast("bigint"))


def _trails(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored hits as trails (the card's words as terms), an item's gold files as usage."""
    items = table(s, d, "eval_items").select("item_id", "query", "gold")
    hits = _hits(s, d).select("item_id", "path", "hit_id", T.tokenize(F.coalesce("card", F.lit(""))).alias("terms"))
    trails = hits.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("hit_id", "path", "terms"))).alias("h")).join(items, "item_id")
    return trails.select("query", F.transform("h", lambda h: F.struct(h["path"].alias("path"), h["terms"].alias("terms"))).alias("candidates")), items.select("query", F.col("gold").alias("used"))


def _keyed(s: SparkSession, d: str) -> DataFrame:
    """Candidates with the key under which a judge's answer is kept."""
    rows = gate.candidates(_hits(s, d).join(table(s, d, "eval_items").select("item_id", "query"), "item_id"))
    one = F.array(F.struct(F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce("name", F.lit("")).alias("name")))
    return rows.withColumn("key", gate.cache_key("judge-1", F.col("query"), one))


def _judge(rows: DataFrame) -> DataFrame:
    """A judge for tests: the score, and how short the card is."""
    return rows.select("key", F.col("score").alias("q"), (1 - F.least(F.length("card"), F.lit(500)) / 1000).alias("scope"))


def _cache(rows: DataFrame) -> DataFrame:
    """Answers for every other candidate."""
    return rows.where("k % 2 = 0").select("key", F.col("hit_id").alias("ord"), F.lit(0.8).alias("q"), F.least(F.lit(1.0), F.col("score") + 0.1).alias("scope"))


def _gated(s: SparkSession, d: str) -> DataFrame:
    rows = _keyed(s, d)
    return gate.gated(rows, _cache(rows), _judge)


def _looked_up(s: SparkSession, d: str) -> DataFrame:
    rows = _keyed(s, d)
    return gate.cached(rows, _cache(rows)).select("item_id", "k", "key", F.round("a.q", 6).alias("q"), F.round("a.scope", 6).alias("scope"))


def _states(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The records of each file delivered first and last."""
    rows = table(s, d, "file_parse").where("path IS NOT NULL")
    old = rows.groupBy("repo", "path").agg(F.min_by(F.struct("content_hash", "calls", "imports"), F.struct("parsed_at", "received_at")).alias("x")).select("repo", "path", "x.*")
    return old, current(s, d, "content_hash", "calls", "imports")


def _hash_diff(s: SparkSession, d: str) -> DataFrame:
    old, new = _states(s, d)
    return new.select("repo", "path", "content_hash").join(old.select("repo", "path", "content_hash"), ["repo", "path", "content_hash"], "left_anti")


def _refingered(s: SparkSession, d: str) -> DataFrame:
    old, new = _states(s, d)
    before = files.fingerprints(old).withColumnRenamed("fingerprint", "old")
    return files.fingerprints(new).join(before, ["repo", "path"], "left").where(~F.col("fingerprint").eqNullSafe(F.col("old"))).select("repo", "path")


def _payload(s: SparkSession, d: str) -> DataFrame:
    """The candidates as a judge gets them, read back from the JSON."""
    schema = "candidates ARRAY<STRUCT<k: BIGINT, path: STRING, line: BIGINT, kind: STRING, name: STRING, card: STRING>>"
    rows = gate.payload(gate.candidates(_hits(s, d)))
    return rows.select("item_id", F.explode(F.from_json("payload", schema)["candidates"]).alias("c")).select("item_id", "c.*")


def _saved_lexicon(s: SparkSession, d: str) -> DataFrame:
    """What was learned, saved as a lexicon and loaded again."""
    path = made(f"{shared_dir(s)}/lexicon-{uuid.uuid4().hex}.json")
    learn.save_lexicon(learn.learned(*_trails(s, d)), path)
    return learn.load_lexicon(s, path)


def _marks(s: SparkSession, d: str) -> DataFrame:
    """Files marked as used for two queries, read back from the feed."""
    path = made(f"{shared_dir(s)}/usage-{uuid.uuid4().hex}")
    learn.mark_used(s, "Where is the SEALED replica?", ["a.rs", "b.rs"], path)
    learn.mark_used(s, _QUERY, ["c.py"], path)
    rows = jsonl.read_or_empty(s, path, "query STRING, used ARRAY<STRING>")
    return rows.select(T.norm_query("query").alias("norm"), F.array_join("used", ", ").alias("used"))


QUERIES = {
    "doc_freq": lambda s, d: search.document_frequency(_units(s, d)),
    "idf_search_topk": lambda s, d: search.search(_units(s, d), _QUERY, with_fuzzy=False),
    "regex_search": lambda s, d: search.search(_units(s, d), r"re:encode_\w+_replica|Err\(", n=50),
    "lexicon_boost_search": lambda s, d: search.search(_units(s, d), _QUERY, lexicon=_LEXICON, with_fuzzy=False),
    "fuzzy_search": lambda s, d: search.search(_units(s, d), "encrep"),
    "unit_search_topk": lambda s, d: search.search(_unit_table(s, d), "badge stream", with_fuzzy=False),
    "batch_search": lambda s, d: search.batch_search(_units(s, d), table(s, d, "eval_items").select("item_id", "query")),
    "tf_baseline": lambda s, d: evaluate.term_frequency(texts(s, d), ["replica", "sealed"], 20),
    "file_rank_first_mention": lambda s, d: evaluate.ranked_files(_placed(s, d), 10),
    "recall_mrr": lambda s, d: evaluate.quality(evaluate.ranked_files(_placed(s, d)), table(s, d, "eval_items").select("item_id", "gold"), 10),
    "recall_mean": lambda s, d: evaluate.quality(evaluate.ranked_files(_placed(s, d)), table(s, d, "eval_items").select("item_id", "gold"), 5).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr")),
    "own_recall": lambda s, d: evaluate.quality(evaluate.ranked_files(search.batch_search(_units(s, d), table(s, d, "eval_items").select("item_id", "query"), 50)), table(s, d, "eval_items").select("item_id", "gold"), 10),
    "learn_lexicon": lambda s, d: learn.learned(*_trails(s, d)),
    "holdout_split": lambda s, d: learn.with_split(learn.groups(*_trails(s, d)), 0.2).select("first_path", "norm", "held"),
    "gate_payload": _payload,
    "hit_lines": lambda s, d: _hits(s, d).select("hit_id", report.hit_line(True).alias("text")),
    "lexicon_saved": _saved_lexicon,
    "usage_marks": _marks,
    "gate_verdicts": lambda s, d: _gated(s, d).select("item_id", "k", "path", "name", F.round("q", 6).alias("q"), F.round("scope", 6).alias("scope"), "verdict"),
    "verdict_cache_join": _looked_up,
    "json_answer_extract": lambda s, d: table(s, d, "events").select("event_id", *[a.alias(n) for n, a in zip(("q", "scope"), gate.answers_of(F.concat(F.lit('{"answers": {"q1": {"noul": 0.'), F.get_json_object("props", "$.k"), F.lit("}}}")), F.pmod("event_id", F.lit(2))), strict=True)]),
    "hash_diff": _hash_diff,
    "fingerprint_changed": _refingered,
    "tombstones": lambda s, d: change_log.latest(change_log.changes_of(table(s, d, "change_events"))).where("NOT alive").select("repo", "path", "seq", "arrival_no"),
    "last_write_wins": lambda s, d: change_log.latest(change_log.changes_of(table(s, d, "change_events")).withColumn("path", F.concat_ws("@", "path", F.expr("arrival_no div 500").cast("string")))).select("repo", "path", "seq", "alive"),
}

_U = f"WITH {CUR}, {UNITS}, n AS (SELECT count(*)::DOUBLE AS n FROM unit)"
_TERMS = "q AS (SELECT unnest(['schedule', 'sealed', 'replica']) AS term)"
_IDF = f"{_U}, {_TERMS}, df AS (SELECT term, ln(1 + any_value(n) / (1 + count(u.name))) AS idf FROM q CROSS JOIN n LEFT JOIN unit u ON list_contains(u.terms, q.term) GROUP BY term), total AS (SELECT sum(idf) AS total FROM df)"
_SCORED = "scored AS (SELECT u.*, 0.6 * (SELECT sum(CASE WHEN list_contains(u.terms, term) THEN idf ELSE 0 END) FROM df) / total AS raw FROM unit u, total)"
_HITS = "hit AS (SELECT item_id, path, line, kind, name, score, content_hash, card, min(hit_id) AS hit_id, min(tokens_est) AS tokens_est FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) AND score >= 0 AND path IS NOT NULL GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path NULLS FIRST, name NULLS FIRST, line NULLS FIRST, hit_id) AS place FROM hit)"
_RANKED = f"{_HITS}, ranked AS (SELECT item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY first, path) AS place FROM (SELECT item_id, path, min(place) AS first FROM placed GROUP BY ALL))"
_QUALITY = """gold AS (SELECT item_id, unnest(list_distinct(gold)) AS path FROM eval_items), got AS (SELECT item_id, count(*) AS n, min(place) AS first FROM ranked JOIN gold USING (item_id, path) WHERE place <= {} GROUP BY item_id),
 quality AS (SELECT item_id, round(coalesce(n / greatest(coalesce(len(list_distinct(gold)), 0), 1), 0.0), 9) AS recall, round(coalesce(1 / first, 0.0), 9) AS reciprocal_rank FROM eval_items LEFT JOIN got USING (item_id))"""
_FEED = r"""feed AS (SELECT repo, regexp_replace(replace(coalesce(path, CASE WHEN lower(trim(event)) = 'updated' THEN ir.path END), '\', '/'), '^(\./+)+', '') AS path, seq, arrival_no, lower(trim(event)) = 'updated' AS alive FROM change_events WHERE lower(trim(event)) IN ('updated', 'deleted') AND seq IS NOT NULL)"""
_KEYED = f"""{_HITS}, cand AS (SELECT p.*, query, place - 1 AS k, sha256(concat_ws(chr(31), '1', 'judge-1', query, concat_ws(chr(30), coalesce(content_hash, ''), coalesce(name, '')))) AS key FROM placed p JOIN eval_items USING (item_id) WHERE place <= 20)"""
_WORDS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(card, ''), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu}\p{Lu})(\p{Ll})', '\1 \2', 'g'), '[^\p{L}\p{N}]+'), lambda w: lower(w)), lambda w: w <> '')"
_NORM = r"array_to_string(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}_]+'), lambda w: w <> ''), ' ')"
_GROUPS = f"""{_HITS}, item AS (SELECT *, {_NORM} AS norm FROM eval_items), used AS (SELECT norm, flatten(list(coalesce(gold, []))) AS used FROM item GROUP BY norm),
 trail AS (SELECT item_id, i.norm, list(struct_pack(path := h.path, terms := list_distinct({_WORDS.replace('card', 'h.card')})) ORDER BY hit_id) AS candidates FROM hit h JOIN item i USING (item_id) GROUP BY item_id, i.norm),
 grp AS (SELECT t.*, used, candidates[1].path AS first_path FROM trail t JOIN used USING (norm)), numbered AS (SELECT *, row_number() OVER (ORDER BY first_path, norm) AS k, count(*) OVER () AS n FROM grp),
 split AS (SELECT *, CASE WHEN n >= 2 THEN k > n - least(ceil(n * 0.2), n - 1) ELSE false END AS held FROM numbered)"""

_BATCH = rf"""WITH {CUR}, {UNITS}, n AS (SELECT count(*)::DOUBLE AS n FROM unit),
      q AS (SELECT item_id, unnest({_WORDS.replace("coalesce(card, '')", 'query')}) AS term FROM eval_items), have AS (SELECT DISTINCT repo, path, line, kind, name, unnest(terms) AS term FROM unit),
      df AS (SELECT term, count(*) AS df FROM (SELECT *, row_number() OVER () FROM (SELECT unnest(list_distinct(terms)) AS term FROM unit)) GROUP BY term),
      idf AS (SELECT item_id, term, ln(1 + n / (1 + coalesce(df, 0))) AS idf, df FROM q LEFT JOIN df USING (term), n), total AS (SELECT item_id, sum(idf) AS total FROM idf GROUP BY item_id),
      got AS (SELECT item_id, repo, path, line, kind, name, sum(idf) AS s FROM have JOIN idf USING (term) GROUP BY ALL), scored AS (SELECT got.*, round(s / total, 9) AS score FROM got JOIN total USING (item_id)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path, name, line, repo, kind) AS place FROM scored)"""

ORACLE = {
    "gate_payload": f"WITH {_HITS} SELECT item_id, place - 1 AS k, path, line, kind, name, substr(card, 1, 2000) AS card FROM placed WHERE place <= 20",
    "hit_lines": f"WITH {_HITS} SELECT hit_id, format('{{:.3f}}', score) || ' ' || path || ':' || coalesce(line::VARCHAR, '') || ' ' || coalesce(kind, '') || ' ' || coalesce(name, '') || chr(10) || '  ' || replace(coalesce(card, ''), chr(10), chr(10) || '  ') AS text FROM hit",
    "usage_marks": "SELECT * FROM (VALUES ('where is the sealed replica', 'a.rs, b.rs'), ('schedule sealed replica', 'c.py')) AS t(norm, used)",
    "doc_freq": f"WITH {CUR}, {UNITS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM unit) GROUP BY term",
    "idf_search_topk": f"{_IDF}, {_SCORED} SELECT repo, path, line, kind, name, round(raw, 9) AS score, content_hash, est_tokens AS tokens_est, card FROM scored JOIN (SELECT repo, path, content_hash FROM cur) USING (repo, path) WHERE round(raw, 9) > 0 ORDER BY score DESC, path, name, line, repo LIMIT 20",
    "lexicon_boost_search": f"""{_IDF}, {_SCORED}, boosted AS (SELECT *, round(greatest(0.0, least(1.5, raw + greatest(-0.2, least(0.2, 0.2 * (len(list_filter(terms, lambda t: t IN ('replica', 'sealed'))) - len(list_filter(terms, lambda t: t IN ('path', 'kind')))))))), 9) AS score FROM scored)
      SELECT repo, path, line, kind, name, score, content_hash, est_tokens AS tokens_est, card FROM boosted JOIN (SELECT repo, path, content_hash FROM cur) USING (repo, path) WHERE score > 0 ORDER BY score DESC, path, name, line, repo LIMIT 20""",
    "regex_search": f"WITH {CUR}, {UNITS} SELECT repo, path, line, kind, name, 1.0::DOUBLE AS score, content_hash, est_tokens AS tokens_est, card FROM unit JOIN (SELECT repo, path, content_hash FROM cur) USING (repo, path) WHERE regexp_matches(name, 'encode_\\w+_replica|Err\\(') OR regexp_matches(card, 'encode_\\w+_replica|Err\\(') ORDER BY path, name, line, repo LIMIT 50",
    "batch_search": f"{_BATCH} SELECT item_id, repo, path, line, name, score, place FROM placed WHERE place <= 10",
    "own_recall": f"WITH listed AS (SELECT * FROM ({_BATCH} SELECT * FROM placed)), ranked AS (SELECT item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY first, path) AS place FROM (SELECT item_id, path, min(place) AS first FROM listed WHERE place <= 50 GROUP BY ALL)), {_QUALITY.format(10)} SELECT * FROM quality",
    "tf_baseline": "WITH f AS (SELECT repo, path, lower(text) AS t FROM documents WHERE source = 'repo_file' AND path IS NOT NULL), c AS (SELECT repo, path, ((length(t) - length(replace(t, 'replica', ''))) / 7 + (length(t) - length(replace(t, 'sealed', ''))) / 6)::BIGINT AS score FROM f) SELECT * FROM c WHERE score > 0 ORDER BY score DESC, path, repo LIMIT 20",
    "file_rank_first_mention": f"WITH {_RANKED} SELECT item_id, path, place FROM ranked WHERE place <= 10",
    "recall_mrr": f"WITH {_RANKED}, {_QUALITY.format(10)} SELECT * FROM quality",
    "recall_mean": f"WITH {_RANKED}, {_QUALITY.format(5)} SELECT round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr FROM quality",
    "holdout_split": f"WITH {_GROUPS} SELECT first_path, norm, held FROM split",
    "learn_lexicon": f"""WITH {_GROUPS}, cand AS (SELECT held, unnest(candidates) AS c, used FROM split), m AS (SELECT unnest(c.terms) AS term, held, list_contains(used, c.path) AS u FROM cand),
      r AS (SELECT term, count(*) FILTER (u AND NOT held) / nullif(count(*) FILTER (NOT held), 0) AS p, count(*) FILTER (NOT held) AS total, count(*) FILTER (u AND held) / nullif(count(*) FILTER (held), 0) AS h FROM m GROUP BY term),
      v AS (SELECT term, CASE WHEN p >= 0.7 AND coalesce(h, 1) >= 0.5 THEN 'promote' WHEN p <= 0.3 AND coalesce(h, 0) <= 0.5 THEN 'demote' END AS polarity, 1.0::DOUBLE AS weight FROM r WHERE total >= 5) SELECT * FROM v WHERE polarity IS NOT NULL""",
    "gate_verdicts": f"""WITH {_KEYED}, cache AS (SELECT key, min_by(struct_pack(q := 0.8::DOUBLE, scope := least(1.0, score + 0.1)), hit_id) AS a FROM cand WHERE k % 2 = 0 GROUP BY key),
      fresh AS (SELECT key, max(struct_pack(q := score, scope := 1 - least(length(substr(card, 1, 2000)), 500) / 1000)) AS b FROM cand GROUP BY key),
      judged AS (SELECT c.*, coalesce(a.q, b.q) AS q, coalesce(a.scope, b.scope) AS scope FROM cand c JOIN fresh USING (key) LEFT JOIN cache USING (key)),
      v AS (SELECT *, CASE WHEN least(q, scope) >= 0.7 THEN 'inline' WHEN least(q, scope) >= 0.5 THEN 'include' WHEN least(q, scope) >= 0.25 THEN 'lead' ELSE 'dropped' END AS verdict FROM judged)
      SELECT item_id, k, path, name, round(q, 6) AS q, round(scope, 6) AS scope, verdict FROM v WHERE verdict <> 'dropped'""",
    "verdict_cache_join": f"""WITH {_KEYED}, cache AS (SELECT key, min_by(struct_pack(q := 0.8::DOUBLE, scope := least(1.0, score + 0.1)), hit_id) AS a FROM cand WHERE k % 2 = 0 GROUP BY key)
      SELECT item_id, k, key, round(a.q, 6) AS q, round(a.scope, 6) AS scope FROM cand LEFT JOIN cache USING (key)""",
    "json_answer_extract": "SELECT event_id, 0.0::DOUBLE AS q, 0.0::DOUBLE AS scope FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, ('0.' || (props->>'$.k'))::DOUBLE, 0.0 FROM events WHERE event_id % 2 = 1",
    "hash_diff": f"WITH {CUR}, old AS (SELECT repo, path, content_hash FROM file_parse WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY parsed_at NULLS FIRST, received_at NULLS FIRST) = 1) SELECT repo, path, content_hash FROM cur ANTI JOIN old USING (repo, path, content_hash)",
    "unit_search_topk": """WITH once AS (SELECT unit_id, min(struct_pack(repo := repo, path := path, line := line, kind := kind, name := name, content_hash := content_hash, terms := coalesce(terms, []), target := coalesce(target, ''), card := coalesce(card, ''), est_tokens := est_tokens)) AS u FROM search_units WHERE unit_id IS NOT NULL GROUP BY unit_id),
      unit AS (SELECT unnest(u) FROM once), n AS (SELECT count(*)::DOUBLE AS n FROM unit), q AS (SELECT unnest(['badge', 'stream']) AS term),
      df AS (SELECT term, ln(1 + any_value(n) / (1 + count(u.terms))) AS idf FROM q CROSS JOIN n LEFT JOIN unit u ON list_contains(u.terms, q.term) GROUP BY term), total AS (SELECT sum(idf) AS total FROM df),
      scored AS (SELECT u.*, round(0.6 * (SELECT sum(CASE WHEN list_contains(u.terms, term) THEN idf ELSE 0 END) FROM df) / total, 9) AS score FROM unit u, total)
      SELECT repo, path, line, kind, name, score, content_hash, est_tokens AS tokens_est, card FROM scored WHERE score > 0 ORDER BY score DESC, path NULLS FIRST, name NULLS FIRST, line NULLS FIRST, repo NULLS FIRST LIMIT 20""",
    "fingerprint_changed": f"""WITH {CUR}, old AS (SELECT * FROM file_parse WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY parsed_at NULLS FIRST, received_at NULLS FIRST) = 1)
      SELECT repo, path FROM cur c JOIN old o USING (repo, path) WHERE list_transform(coalesce(c.calls, []), lambda x: (x.callee_name, x.callee_local_key, x.callee_file, x.callee_external)) IS DISTINCT FROM list_transform(coalesce(o.calls, []), lambda x: (x.callee_name, x.callee_local_key, x.callee_file, x.callee_external))
        OR list_transform(coalesce(c.imports, []), lambda x: (x.target_module, x.resolved)) IS DISTINCT FROM list_transform(coalesce(o.imports, []), lambda x: (x.target_module, x.resolved))""",
    "tombstones": f"WITH {_FEED} SELECT repo, path, seq, arrival_no FROM feed WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY seq DESC, arrival_no DESC) = 1 AND NOT alive",
    "last_write_wins": f"WITH {_FEED}, part AS (SELECT *, path || '@' || (arrival_no // 500) AS p FROM feed WHERE path IS NOT NULL) SELECT repo, p AS path, seq, alive FROM part QUALIFY row_number() OVER (PARTITION BY repo, p ORDER BY seq DESC, arrival_no DESC) = 1",
}
ORACLE["lexicon_saved"] = ORACLE["learn_lexicon"]
