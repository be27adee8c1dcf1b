"""Queries on single texts: predicates, classification and rewrites, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.functions import native as N
from gistmill.plans import engine
from gistmill.sources import fixtures as X


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


FAILURE = _sql(N.FAILURE)


def family_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, X.MODELS), F.lit("Claude-x"), F.lit("GPT-4o1"))).alias("m"))
    name = F.concat("m", F.lit("-"), F.col("n_nationkey").cast("string"))
    family = N.family(name)
    return rows.select("n_nationkey", name.alias("model"), family.alias("family"), N.family_value(family, "min_bytes").alias("min_bytes"), N.family_value(family, "head").alias("head_lines"))


FAMILY_SQL = """CASE WHEN lower(model) LIKE '%claude%' THEN 'claude' WHEN lower(model) LIKE '%deepseek%' THEN 'deepseek'
  WHEN regexp_matches(lower(model), 'gpt|o1|o3') THEN 'gpt' ELSE 'generic' END"""
FAMILY_DETECT_SQL = f"""
WITH m AS (SELECT n_nationkey, unnest([{', '.join(repr(m) for m in [*X.MODELS, 'Claude-x', 'GPT-4o1'])}]) || '-' || n_nationkey AS model FROM nation),
f AS (SELECT *, {FAMILY_SQL} AS family FROM m)
SELECT n_nationkey, model, family, CASE family WHEN 'claude' THEN 4096 WHEN 'deepseek' THEN 1024 ELSE 2048 END::INT AS min_bytes,
  CASE family WHEN 'claude' THEN 30 WHEN 'deepseek' THEN 12 ELSE 20 END::INT AS head_lines FROM f"""


def block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    limits = S.Limits(max_block=8192, min_block=100)
    return X.table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text).cast("long").alias("bytes"), N.in_bounds(text).alias("default_in"), N.in_bounds(text, limits).alias("limited_in"),
        N.body_too_large(text, S.Limits(max_body=20000)).alias("too_large"),
    )


BLOCK_BOUNDS_SQL = "SELECT doc_id, strlen(text) AS bytes, strlen(text) >= 64 AS default_in, strlen(text) BETWEEN 100 AND 8192 AS limited_in, strlen(text) > 20000 AS too_large FROM documents"


def fast_bailout(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    body = F.concat(F.lit('{"role":"'), role, F.lit('","content":"'), "text", F.lit('"}'))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length(body).cast("long").alias("bytes"), N.bails_out(body).alias("bails_out"))


FAST_BAILOUT_SQL = """
WITH b AS (SELECT conv_id, turn, '{"role":"' || CASE role WHEN 'assistant' THEN 'tool' ELSE role END || '","content":"' || text || '"}' AS body FROM conversations)
SELECT conv_id, turn, strlen(body) AS bytes, strlen(body) < 256 OR NOT (contains(body, 'tool') OR contains(body, '```') OR contains(body, 'diff --git')) AS bails_out FROM b"""


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return X.texts(spark, sf_dir).select(
        "doc_id", F.size(lines).cast("long").alias("lines"), F.size(N.router_lines(F.col("text"))).cast("long").alias("router_lines"),
        F.size(F.filter(lines, lambda s: F.trim(s) == "")).cast("long").alias("blank"), F.array_max(F.transform(lines, lambda s: F.octet_length(s))).cast("long").alias("longest"),
    )


LINE_STATS_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, len(l) AS lines, len(l) - (l[-1] = '')::INT AS router_lines, len(list_filter(l, lambda s: trim(s) = '')) AS blank, list_max(list_transform(l, lambda s: strlen(s))) AS longest FROM l"""


def mustkeep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.log_lines(spark, sf_dir)
    return lines.groupBy("user_id").agg(F.count("*").alias("lines"), F.count_if(N.must_keep(F.col("line"))).alias("kept"), F.count_if(N.time_prefixed(F.col("line"))).alias("dated"))


MUSTKEEP_SQL = f"WITH {X.LOGS} SELECT user_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '{FAILURE}')) AS kept, count(*) FILTER (regexp_matches(line, '{N.TIME_PREFIX}')) AS dated FROM lines GROUP BY user_id"


def diagnostic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = X.event_k(), F.col("event_id").cast("string")
    line = F.element_at(
        F.array(F.concat(F.lit("src/f"), n, F.lit(".py:"), k, F.lit(":1: unused")), F.concat(n, F.lit(":"), k, F.lit(": x")), F.concat(F.lit("10:00:"), F.lpad(F.substring(k, 1, 2), 2, "0"), F.lit(":9: late")), F.concat(F.lit("a.go:x"), k), F.concat(F.lit("m.c:"), k)),
        (F.pmod("event_id", F.lit(5)) + 1).cast("int"),
    )
    rows = X.table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return rows.select("event_id", "line", N.diagnostic(F.col("line")).alias("diagnostic"), N.time_prefixed(F.col("line")).alias("dated"))


DIAGNOSTIC_SQL = f"""
WITH e AS (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events),
l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'src/f' || event_id || '.py:' || k || ':1: unused' WHEN 1 THEN event_id || ':' || k || ': x'
  WHEN 2 THEN '10:00:' || lpad(left(k, 2), 2, '0') || ':9: late' WHEN 3 THEN 'a.go:x' || k ELSE 'm.c:' || k END AS line FROM e)
SELECT event_id, line, regexp_matches(line, '{N.DIAGNOSTIC}') AND NOT regexp_matches(line, '{N.TIME_PREFIX}') AND NOT regexp_matches(line, '{N.ALL_DIGITS}') AS diagnostic,
  regexp_matches(line, '{N.TIME_PREFIX}') AS dated FROM l"""


def classify_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.with_kind(X.logs(spark, sf_dir), "blob", "kind", scores=True).select("user_id", "test_score", "log_score", "kind")


def _count_sql(text: str, tokens: list[str]) -> str:
    return " + ".join(f"(strlen({text}) - strlen(replace({text}, '{t}', ''))) // {len(t.encode())}" for t in tokens)


_STARTS = _sql("^" + N.any_of(S.CRASH_STARTS))
CLASSIFY_LOG_SQL = f"""
WITH {X.LOGS}, s AS (SELECT user_id, blob, list_transform(string_split(blob, chr(10)), lambda x: trim(x)) AS l FROM logs),
t AS (SELECT user_id, blob, l, {_count_sql('blob', S.TEST_TOKENS)} + len(list_filter(l, lambda x: regexp_matches(x, '{_STARTS}')))
   + len(list_filter(l, lambda x: regexp_matches(x, '{N.DIAGNOSTIC}') AND NOT regexp_matches(x, '{N.TIME_PREFIX}') AND NOT regexp_matches(x, '{N.ALL_DIGITS}'))) AS test_score,
  least(3, len(list_filter(l, lambda x: strlen(x) > 20 AND (regexp_matches(x, '^.{{4}}-..-') OR regexp_matches(x, '^..:..:'))))) AS dated FROM s),
g AS (SELECT *, {_count_sql('blob', S.LOG_LEVELS)} + dated AS log_score FROM t)
SELECT user_id, test_score::BIGINT AS test_score, log_score::BIGINT AS log_score, CASE WHEN test_score >= 3 THEN 'test_output'
  WHEN log_score >= 3 AND (dated >= 3 OR regexp_matches(substr(blob, 1, 8192), '\\[|level=|lvl=')) THEN 'log_output' ELSE 'prose' END AS kind FROM g"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and text of documents, logs and JSON arrays."""
    docs = X.texts(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "text")
    logs = X.logs(spark, sf_dir).select(F.concat(F.lit("log-"), F.col("user_id").cast("string")).alias("id"), F.col("blob").alias("text"))
    arrays = X.arrays(spark, sf_dir).select(F.concat(F.lit("json-"), F.col("user_id").cast("string")).alias("id"), F.col("doc").alias("text"))
    return docs.unionByName(logs).unionByName(arrays)


def classify_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.classified(mixed(spark, sf_dir), "id", "text")


_STARTS_WITH = lambda words: _sql("^" + N.any_of(words))
CLASSIFY_ALL_SQL = f"""
WITH {X.LOGS}, arrays AS (SELECT user_id, '[' || string_agg('{{"event_id":' || event_id || ',"type":"' || event_type || '","k":' || regexp_extract(props, '([0-9]+)', 1) || ',"source":"web"}}', ',' ORDER BY event_id) || ']' AS doc FROM events GROUP BY user_id),
u AS (SELECT 'doc-' || doc_id AS id, text FROM documents UNION ALL SELECT 'log-' || user_id, blob FROM logs UNION ALL SELECT 'json-' || user_id, doc FROM arrays),
l AS (SELECT id, text, string_split(text, chr(10)) AS raw, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l, string_split(left(text, 8192), chr(10)) AS head FROM u),
o AS (SELECT *, list_position(list_transform(head, lambda x: regexp_matches(x, '{_STARTS_WITH(S.CODE_OPENERS)}')), true) AS opener FROM l),
t AS (SELECT *, opener IS NOT NULL AND len(list_filter(head[1 : opener - 1], lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '{_STARTS_WITH(S.COMMENT_STARTS)}'))) < 12
   AND len(list_filter(l, lambda x: regexp_matches(x, '{_STARTS_WITH(S.CODE_STARTS)}'))) >= 2 AS code,
  {_count_sql('text', S.TEST_TOKENS)} + len(list_filter(l, lambda x: regexp_matches(x, '{_STARTS}')))
   + len(list_filter(l, lambda x: regexp_matches(x, '{N.DIAGNOSTIC}') AND NOT regexp_matches(x, '{N.TIME_PREFIX}') AND NOT regexp_matches(x, '{N.ALL_DIGITS}'))) AS test_score,
  least(3, len(list_filter(raw, lambda x: strlen(x) > 20 AND (regexp_matches(x, '^.{{4}}-..-') OR regexp_matches(x, '^..:..:'))))) AS dated FROM o)
SELECT id, CASE WHEN regexp_matches(left(text, 8192), '^\\s*([{{\\[])') AND json_valid(left(text, 8192)) THEN 'json' WHEN code THEN 'code' WHEN test_score >= 3 THEN 'test_output'
  WHEN {_count_sql('text', S.LOG_LEVELS)} + dated >= 3 AND (dated >= 3 OR regexp_matches(left(text, 8192), '\\[|level=|lvl=')) THEN 'log_output' ELSE 'prose' END AS kind FROM t"""


_FOLD = f"""list_reduce(list_prepend({{'kept': []::VARCHAR[], 'context': 0, 'dropped': 0, 'line': ''}},
    list_transform(middle, lambda x: {{'kept': []::VARCHAR[], 'context': 0, 'dropped': 0, 'line': x}})),
  lambda s, x: {{
    'kept': CASE WHEN len(s.kept) < 50 AND (s.context > 0 OR regexp_matches(x.line, '{FAILURE}')) THEN list_append(s.kept, x.line) ELSE s.kept END,
    'context': CASE WHEN s.context > 0 THEN s.context - 1 WHEN len(s.kept) < 50 AND regexp_matches(x.line, '{FAILURE}') THEN 2 ELSE 0 END,
    'dropped': s.dropped + (s.context = 0 AND len(s.kept) >= 50 AND regexp_matches(x.line, '{FAILURE}'))::INT, 'line': ''}})"""


def _elided_sql(rows: str) -> str:
    """CTEs that end in ``elided`` (user_id, family, blob, out); ``rows`` gives user_id, family and blob."""
    return f"""r AS ({rows}),
p AS (SELECT *, CASE family WHEN 'claude' THEN 4096 WHEN 'deepseek' THEN 1024 ELSE 2048 END AS floor_bytes,
  CASE family WHEN 'claude' THEN 30 WHEN 'deepseek' THEN 12 ELSE 20 END AS n, string_split(blob, chr(10)) AS l FROM r),
m AS (SELECT *, l[n + 1 : len(l) - n] AS middle, l[1 : n] AS head, l[len(l) - n + 1 :] AS tail FROM p),
f AS (SELECT *, {_FOLD} AS s FROM m),
o AS (SELECT *, array_to_string(list_concat(head, ['[... {S.TAG}: ' || (len(middle) - len(s.kept)) || ' middle lines elided · full text kept locally as ' || left(sha256(blob), 12) || ' '
  || CASE WHEN s.dropped > 0 THEN '· ' || s.dropped || ' more failure lines over cap=50, see local copy ' ELSE '' END || '...]'], s.kept, tail), chr(10)) AS made FROM f),
elided AS (SELECT user_id, family, blob, CASE WHEN strlen(blob) >= floor_bytes AND len(l) > 2 * n + 2 AND strlen(made) <= strlen(blob) * 0.9 THEN made ELSE blob END AS out FROM o)"""


def elide_headtail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.with_elision(X.logs(spark, sf_dir), "blob", F.lit("deepseek"), "out")
    return rows.select("user_id", F.octet_length("blob").cast("long").alias("original_bytes"), "out")


ELIDE_SQL = f"WITH {X.LOGS}, {_elided_sql(chr(39).join(['SELECT user_id, ', 'deepseek', ' AS family, blob FROM logs']))} SELECT user_id, strlen(blob) AS original_bytes, out FROM elided"


def _with_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, S.FAMILIES))
    return X.logs(spark, sf_dir).withColumn("family", F.element_at(names, (F.pmod("user_id", F.lit(4)) + 1).cast("int")))


_WITH_FAMILY_SQL = f"SELECT user_id, list_extract({list(S.FAMILIES)}, (user_id % 4 + 1)::INT) AS family, blob FROM logs"


def elide_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each user's log, classified, elided for a model family, and what that saves."""
    rows = N.with_elision(N.with_kind(_with_family(spark, sf_dir), "blob", "kind"), "blob", F.col("family"), "out")
    sent = F.when(F.col("kind").isin("test_output", "log_output"), F.octet_length("out")).otherwise(F.octet_length("blob"))
    rows = rows.select("user_id", "family", "kind", F.octet_length("blob").cast("long").alias("original_bytes"), sent.cast("long").alias("sent_bytes"))
    return rows.withColumn("saved_bytes", F.col("original_bytes") - F.col("sent_bytes"))


ELIDE_SAVINGS_SQL = f"""WITH {X.LOGS}, {_elided_sql(_WITH_FAMILY_SQL)}
SELECT user_id, family, 'log_output' AS kind, strlen(blob) AS original_bytes, strlen(out) AS sent_bytes, strlen(blob) - strlen(out) AS saved_bytes FROM elided"""


def savings_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elide_savings(spark, sf_dir)
    return rows.groupBy("family").agg(
        F.count("*").alias("blobs"), F.count_if(F.col("saved_bytes") > 0).alias("fired"), F.sum("original_bytes").alias("original_bytes"), F.sum("sent_bytes").alias("sent_bytes")
    )


SAVINGS_BY_FAMILY_SQL = f"SELECT family, count(*) AS blobs, count(*) FILTER (saved_bytes > 0) AS fired, sum(original_bytes)::BIGINT AS original_bytes, sum(sent_bytes)::BIGINT AS sent_bytes FROM ({ELIDE_SAVINGS_SQL}) GROUP BY family"


def savings_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of the saved percent where something was saved, by family."""
    rows = elide_savings(spark, sf_dir).filter("saved_bytes > 0").withColumn("pct", N.saved_pct(F.col("original_bytes"), F.col("sent_bytes")))
    return rows.groupBy("family").agg(F.round(F.percentile("pct", 0.5), 4).alias("median_pct"), F.round(F.percentile("pct", 0.95), 4).alias("p95_pct"))


SAVINGS_PERCENTILES_SQL = f"""SELECT family, round(quantile_cont(pct, 0.5), 4) AS median_pct, round(quantile_cont(pct, 0.95), 4) AS p95_pct
FROM (SELECT family, round(100.0::DOUBLE * saved_bytes / original_bytes, 1) AS pct FROM ({ELIDE_SAVINGS_SQL}) WHERE saved_bytes > 0) GROUP BY family"""


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with colours, an unfinished sequence, a title sequence and carriage returns."""
    esc = "\x1b"
    coloured = F.regexp_replace("blob", "(ERROR|INFO)", f"{esc}[31m$1{esc}[0m")
    titled = F.concat(F.lit(f"{esc}]0;title\x07"), F.replace(coloured, F.lit("\n"), F.lit("\r\n")), F.lit(f"\n10%\r50%\r100%\r  \nend{esc}[12"))
    return X.logs(spark, sf_dir).select("user_id", titled.alias("dirty"))


_DIRTY_SQL = f"""{X.LOGS}, dirty AS (SELECT user_id, chr(27) || ']0;title' || chr(7) || replace(regexp_replace(blob, '(ERROR|INFO)', chr(27) || '[31m\\1' || chr(27) || '[0m', 'g'), chr(10), chr(13) || chr(10))
  || chr(10) || '10%' || chr(13) || '50%' || chr(13) || '100%' || chr(13) || '  ' || chr(10) || 'end' || chr(27) || '[12' AS dirty FROM logs)"""


def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("user_id", N.strip_ansi(F.col("dirty")).alias("out"))


STRIP_ANSI_SQL = f"WITH {_DIRTY_SQL} SELECT user_id, regexp_replace(dirty, '\\x1b\\[[^\\x40-\\x7e]*[\\x40-\\x7e]|\\x1b\\][^\\x07]*\\x07', '', 'g') AS out FROM dirty"


def clean_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select("user_id", N.clean_returns(F.col("dirty")).alias("out"))


CLEAN_RETURNS_SQL = f"""WITH {_DIRTY_SQL} SELECT user_id, array_to_string(list_transform(string_split(replace(dirty, chr(13) || chr(10), chr(10)), chr(10)),
  lambda s: CASE WHEN contains(s, chr(13)) THEN coalesce(list_filter(string_split(s, chr(13)), lambda p: trim(p) <> '')[-1], '') ELSE s END), chr(10)) AS out FROM dirty"""


def fold_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.texts(spark, sf_dir).select("doc_id", N.fold_repeats(F.col("text")).alias("folded"))
    return rows.select("doc_id", F.sha2("folded", 256).alias("folded_sha"), F.octet_length("folded").cast("long").alias("folded_bytes"))


FOLD_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS run FROM l),
g AS (SELECT doc_id, line, run, min(i) AS first, count(*) AS n FROM r GROUP BY doc_id, line, run),
t AS (SELECT doc_id, max(first + n - 1) AS total FROM g GROUP BY doc_id),
o AS (SELECT g.doc_id, first, CASE WHEN n > 3 AND trim(line) <> '' AND total > 3 THEN line || chr(10) || '    [... line repeated ' || (n - 1) || ' times ...]'
  ELSE array_to_string(list_transform(range(n), lambda x: line), chr(10)) END AS part FROM g JOIN t USING (doc_id)),
f AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY first) AS out FROM o GROUP BY doc_id)
SELECT doc_id, sha256(out) AS folded_sha, strlen(out) AS folded_bytes FROM f"""


def text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a byte order mark, without it and in lower case of ASCII."""
    text = N.without_bom(F.concat(F.lit("\ufeff"), "text"))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("text_sha"), F.sha2(N.ascii_lower(F.concat(F.lit("ÀÉ"), text)), 256).alias("lower_sha"), F.sha2(N.without_bom(text), 256).alias("again_sha"))


TEXT_MARKS_SQL = "SELECT doc_id, sha256(text) AS text_sha, sha256('ÀÉ' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower_sha, sha256(text) AS again_sha FROM documents"


def lockfile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, PATHS))).alias("p"))
    path = F.concat(F.lit("d"), F.col("n_nationkey").cast("string"), F.lit("/"), "p")
    return rows.select(path.alias("path"), N.generated_path(path).alias("generated"))


PATHS = ["package-lock.json", "sub/Yarn.LOCK", "go.sum", "main.go", "x.min.js", "x.min.css", "app.js.map", "map", "min.js", "Cargo.lock/readme", "go.sum.txt", "flake.lock"]
LOCKFILE_SQL = f"""
WITH p AS (SELECT 'd' || n_nationkey || '/' || unnest({PATHS}) AS path FROM nation), b AS (SELECT path, lower(string_split(path, '/')[-1]) AS base FROM p)
SELECT path, base IN ({', '.join(repr(x) for x in S.LOCKFILES)}) OR suffix(base, '.map') OR suffix(base, '.min.js') OR suffix(base, '.min.css') AS generated FROM b"""


def gate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native parts of the gate, over documents, logs and JSON."""
    text = F.col("text")
    return mixed(spark, sf_dir).select(
        "id", text.rlike(r"(?U)^\s*[{\[]").alias("bracketed"), N.prunable(text).alias("prunable"), N.unified_diff(text).alias("diff"), (F.contains(text, F.lit("\x1b")) | F.contains(text, F.lit("\r"))).alias("terminal")
    )


GATE_SQL = f"""WITH {X.LOGS}, arrays AS (SELECT user_id, '[' || string_agg('{{"event_id":' || event_id || ',"type":"' || event_type || '","k":' || regexp_extract(props, '([0-9]+)', 1) || ',"source":"web"}}', ',' ORDER BY event_id) || ']' AS doc FROM events GROUP BY user_id),
u AS (SELECT 'doc-' || doc_id AS id, text FROM documents UNION ALL SELECT 'log-' || user_id, blob FROM logs UNION ALL SELECT 'json-' || user_id, doc FROM arrays)
SELECT id, regexp_matches(text, '^\\s*[{{\\[]') AS bracketed, regexp_matches(text, '{_sql(N.PRUNABLE)}') OR contains(text, '\\u00') AS prunable,
  contains(text, 'diff --git ') OR (contains(text, '--- a/') AND contains(text, '+++ b/')) OR (contains(text, '--- ') AND contains(text, '+++ ') AND contains(text, '@@ -')) AS diff,
  contains(text, chr(27)) OR contains(text, chr(13)) AS terminal FROM u"""


def prunable_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "events")
    doc = F.element_at(
        F.array(F.col("props"), F.concat(F.lit('{"a":NULL,"b":'), "props", F.lit("}")), F.lit('{"ETag":1}'), F.lit('{"x":[ \t]}'), F.lit('{"x":[0]}'), F.lit('"\\u0041"'), F.concat(F.lit('{"y":{ }, "p":'), "props", F.lit("}"))),
        (F.pmod("event_id", F.lit(7)) + 1).cast("int"),
    )
    return rows.select("event_id", doc.alias("doc")).select("event_id", "doc", N.prunable(F.col("doc")).alias("prunable"))


PRUNABLE_SQL = f"""
WITH d AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN '{{"a":NULL,"b":' || props || '}}' WHEN 2 THEN '{{"ETag":1}}' WHEN 3 THEN '{{"x":[ ' || chr(9) || ']}}'
  WHEN 4 THEN '{{"x":[0]}}' WHEN 5 THEN '"\\u0041"' ELSE '{{"y":{{ }}, "p":' || props || '}}' END AS doc FROM events)
SELECT event_id, doc, regexp_matches(doc, '{_sql(N.PRUNABLE)}') OR contains(doc, '\\u00') AS prunable FROM d"""


def block_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13 on logs: the exact cascade in an Arrow UDF; it must agree with the native elision."""
    return engine.distilled(X.logs(spark, sf_dir), "user_id", "blob", "deepseek").select("user_id", "out", "pass")


CASCADE_SQL = f"""WITH {X.LOGS}, {_elided_sql("SELECT user_id, 'deepseek' AS family, blob FROM logs")}
SELECT user_id, out, CASE WHEN out = blob THEN 'none' ELSE 'elide' END AS pass FROM elided"""


def document_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13 on documents with runs of repeated lines folded even where no other pass applies."""
    rows = engine.distilled(X.texts(spark, sf_dir), "doc_id", "text", fold_ungated=True)
    return rows.select("doc_id", "pass", F.octet_length("out").cast("long").alias("out_bytes"))


DOCUMENT_CASCADE_SQL = f"""SELECT doc_id, CASE WHEN b >= 64 AND folded_bytes < b * 9 // 10 THEN 'terminal' ELSE 'none' END AS pass,
  CASE WHEN b >= 64 AND folded_bytes < b * 9 // 10 THEN folded_bytes ELSE b END AS out_bytes FROM ({FOLD_SQL}) JOIN (SELECT doc_id, strlen(text) AS b FROM documents) USING (doc_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        family_detect, block_bounds, fast_bailout, line_stats, mustkeep_lines, diagnostic_lines, classify_log, classify_all, elide_headtail, elide_savings, savings_by_family,
        savings_percentiles, strip_ansi, clean_returns, fold_repeats, text_marks, lockfile_paths, gate_flags, prunable_feature, block_cascade, document_cascade,
    )
}
SQL = {
    "family_detect": FAMILY_DETECT_SQL, "block_bounds": BLOCK_BOUNDS_SQL, "fast_bailout": FAST_BAILOUT_SQL, "line_stats": LINE_STATS_SQL, "mustkeep_lines": MUSTKEEP_SQL, "diagnostic_lines": DIAGNOSTIC_SQL,
    "classify_log": CLASSIFY_LOG_SQL, "elide_headtail": ELIDE_SQL, "elide_savings": ELIDE_SAVINGS_SQL, "savings_by_family": SAVINGS_BY_FAMILY_SQL, "savings_percentiles": SAVINGS_PERCENTILES_SQL,
    "strip_ansi": STRIP_ANSI_SQL, "clean_returns": CLEAN_RETURNS_SQL, "fold_repeats": FOLD_SQL, "text_marks": TEXT_MARKS_SQL, "lockfile_paths": LOCKFILE_SQL, "gate_flags": GATE_SQL, "prunable_feature": PRUNABLE_SQL, "block_cascade": CASCADE_SQL,
    "classify_all": CLASSIFY_ALL_SQL, "document_cascade": DOCUMENT_CASCADE_SQL,
}
