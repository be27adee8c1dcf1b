"""Queries on whole request bodies: formats, blocks, the engine and its reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.functions import native as N
from gistmill.functions import registry
from gistmill.operators import sets, texts
from gistmill.plans import engine, tables
from gistmill.plans.engine import Engine, explode_blocks, wire_format
from gistmill.sources import files
from gistmill.sources import fixtures as X
from gistmill.streaming import turns

FORMATS = [
    '{"instructions":"be brief","input":"hi"}', '{"input":[1]}', '{"system":"s","messages":[]}', '{"messages":[{"role":"user","content":[{"tool_use_id":"x"}]}]}',
    '{"messages":[]}', '{"input":null,"messages":[]}', '{"model":"m"}', "[]", "null", "{oops", '{"messages":[]} x', "", '{"Messages":[1]}', '{"system":null,"messages":null}',
]


def wire_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 on bodies of every kind, for each nation."""
    rows = X.table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*map(F.lit, FORMATS))).alias("shape", "body"))
    rows = rows.select((F.col("n_nationkey") * len(FORMATS) + F.col("shape")).cast("long").alias("request_id"), "body")
    return wire_format(rows)


_CASES = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(["openai_responses", "openai_responses", "anthropic_messages", "anthropic_messages", "openai_chat", "openai_chat", *["unknown"] * 6, "openai_chat", "unknown"]))
WIRE_SQL = f"SELECT (n_nationkey * {len(FORMATS)} + shape)::BIGINT AS request_id, CASE shape {_CASES} END AS format FROM nation, (SELECT unnest(range({len(FORMATS)})) AS shape)"


def explode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of chat bodies, with their turns; places are checked by cutting the body there."""
    made = X.bodies(spark, sf_dir)
    found = explode_blocks(made).join(made.select("request_id", "body"), "request_id")
    raw = F.expr("decode(substring(encode(body, 'utf-8'), byte_start + 1, byte_len), 'utf-8')")
    exact = raw == F.expr("substring(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)")
    return found.select("request_id", F.col("turn").cast("long").alias("turn"), "role", "is_user", F.sha2("text", 256).alias("text_sha"), exact.alias("in_place"))


EXPLODE_SQL = """
SELECT conv_id AS request_id, turn + 1 AS turn, CASE role WHEN 'assistant' THEN 'tool' ELSE role END AS role, role = 'user' AS is_user, sha256(text) AS text_sha, true AS in_place
FROM conversations WHERE role IN ('user', 'assistant')"""


#: Wrappers of a text in user text, in turn; the last is tool output as a whole, and after it comes text without a wrapper.
WRAPPED = [("look: <" + t + ' id="1">', "</" + t + "> above") for t in S.WRAPPER_TAGS] + [("look\n" + f + "\n", "\n``` above") for f in S.WRAPPER_FENCES] + [(S.WHOLE_STARTS[2] + "\n", "")]


def user_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs quoted by users in every kind of wrapper, as text that is tool output as a whole, and bare: only what is wrapped, or whole, is distilled."""
    shape = F.pmod("user_id", F.lit(len(WRAPPED) + 1))
    text = F.col("blob")
    for i, (before, after) in enumerate(WRAPPED):
        text = F.when(shape == i, F.concat(F.lit(before), "blob", F.lit(after))).otherwise(text)
    return engine.distilled_user(X.logs(spark, sf_dir).select("user_id", text.alias("text")), "user_id", "text", "deepseek").select("user_id", "out", "pass")


def _quoted_sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SHAPE = f"user_id % {len(WRAPPED) + 1}"
_BEFORE, _AFTER = (f"CASE {_SHAPE} " + " ".join(f"WHEN {i} THEN {_quoted_sql(w[k])}" for i, w in enumerate(WRAPPED[:-1])) + " ELSE '' END" for k in (0, 1))
_INNER = f"CASE WHEN {_SHAPE} = {len(WRAPPED) - 1} THEN {_quoted_sql(WRAPPED[-1][0])} || blob ELSE blob END"
WRAPPER_SQL = f"""WITH {X.LOGS}, {texts._elided_sql(f"SELECT user_id, 'deepseek' AS family, {_INNER} AS blob FROM logs")}
SELECT user_id, CASE WHEN {_SHAPE} = {len(WRAPPED)} THEN blob ELSE {_BEFORE} || out || {_AFTER} END AS out, CASE WHEN {_SHAPE} < {len(WRAPPED)} AND out <> blob THEN 'user' ELSE 'none' END AS pass FROM elided"""


def request_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine on bodies in which a log is read twice and quoted: the report of each, without the body."""
    out = Engine(spark).apply(X.log_bodies(spark, sf_dir))
    return out.select("request_id", "format", "family", "original_bytes", "sent_bytes", "saved_bytes", "blocks", "memo_hits", "skipped", "error")


def _body_sql(first: str, second: str, quoted: str) -> str:
    return f"""'{{"model":"' || model || '","messages":[{{"role":"user","content":"go"}},{{"role":"tool","content":' || {first} || '}},{{"role":"tool","content":' || {second} || '}},{{"role":"user","content":"' || {quoted} || '"}}]}}'"""


#: What the engine must make of the log bodies: the first reading elided, the second a reference to it (from 512 bytes), the quotation elided.
EXPECTED = f"""WITH {X.LOGS}, q AS (SELECT user_id, blob, list_extract({X.MODELS}, (user_id % {len(X.MODELS)} + 1)::INT) AS model FROM logs),
{texts._elided_sql(f"SELECT user_id, {texts.FAMILY_SQL} AS family, blob FROM q")},
j AS (SELECT e.user_id, model, family, e.blob, out, to_json(e.blob)::VARCHAR AS a, to_json(out)::VARCHAR AS b,
  CASE WHEN strlen(e.blob) >= 512 THEN '[... {S.TAG}: identical to the copy in turn 2 above (' || strlen(e.blob) || ' bytes) · ref ' || left(sha256(e.blob), 12) || ' ...]' ELSE out END AS again FROM elided e JOIN q USING (user_id)),
k AS (SELECT *, {_body_sql("a", "a", "'see <tool_output>' || a[2:-2] || '</tool_output> above'")} AS before,
  {_body_sql("b", "to_json(again)::VARCHAR", "CASE WHEN out = blob THEN 'see <tool_output>' || a[2:-2] || '</tool_output> above' ELSE 'see ' || chr(92) || 'u003ctool_output' || chr(92) || 'u003e' || b[2:-2] || chr(92) || 'u003c/tool_output' || chr(92) || 'u003e above' END")} AS after,
  2 * (out <> blob)::INT + (again <> blob)::INT AS blocks FROM j)"""
RESULTS_SQL = f"""{EXPECTED} SELECT user_id AS request_id, 'openai_chat' AS format, family, strlen(before) AS original_bytes, strlen(after) AS sent_bytes, strlen(before) - strlen(after) AS saved_bytes,
  blocks::BIGINT AS blocks, 0::BIGINT AS memo_hits, false AS skipped, NULL::VARCHAR AS error FROM k"""
SHARED_SQL = f"{EXPECTED} SELECT user_id AS request_id, blocks::BIGINT AS blocks, sha256(after) AS body_sha FROM k"
_QUOTED = "'see <tool_output>' || blob || '</tool_output> above'"
ORIGINALS_SQL = f"""{EXPECTED}, t AS (SELECT blob AS text FROM k WHERE again <> blob OR out <> blob UNION SELECT {_QUOTED} FROM k WHERE out <> blob)
SELECT DISTINCT sha256(text) AS ref, strlen(text) AS bytes, true AS resolves FROM t"""
_PASSES = f"""SELECT family, 'elide' AS pass, strlen(blob) - strlen(out) AS saved FROM k WHERE out <> blob UNION ALL SELECT family, CASE WHEN strlen(blob) >= 512 THEN 'repeat' ELSE 'elide' END, strlen(blob) - strlen(again) FROM k WHERE again <> blob
  UNION ALL SELECT family, 'user', strlen(blob) - strlen(out) FROM k WHERE out <> blob"""
ROLLUP_SQL = f"{EXPECTED}, d AS ({_PASSES}) SELECT family, pass, count(*) AS blocks, sum(saved)::BIGINT AS saved_bytes FROM d GROUP BY ROLLUP (family, pass)"
SQL_FUNCTIONS_SQL = f"""WITH {X.LOGS}, n AS (SELECT user_id, count(*) AS n FROM lines GROUP BY user_id),
{texts._elided_sql(f"SELECT 2 * user_id + q AS user_id, 'gpt' AS family, CASE q WHEN 0 THEN blob ELSE {_QUOTED} END AS blob FROM logs, (SELECT unnest([0, 1]) AS q)")},
b AS (SELECT user_id // 2 AS user_id, unnest(CASE user_id % 2 WHEN 0 THEN [{{'turn': 1, 'role': 'user', 'out': 'go'}}, {{'turn': 2, 'role': 'tool', 'out': out}}, {{'turn': 3, 'role': 'tool', 'out': out}}]
  ELSE [{{'turn': 4, 'role': 'user', 'out': out}}] END) AS m FROM elided)
SELECT user_id AS request_id, 'openai_chat' AS format, m.turn AS turn, m.role AS role, CASE WHEN m.turn > 1 AND n >= CASE WHEN m.turn = 4 THEN 4 ELSE 3 END THEN 'log_output' ELSE 'prose' END AS kind, sha256(m.out) AS out_sha
FROM b JOIN n USING (user_id)"""


def originals_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that a result replaced can be found by its ref."""
    engine = Engine(spark)
    results = engine.apply(X.log_bodies(spark, sf_dir))
    return engine.originals(results).select("ref", F.octet_length("text").cast("long").alias("bytes"), (F.sha2("text", 256) == F.col("ref")).alias("resolves"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL surface: blocks of bodies by a lateral table function, classified and distilled by name."""
    registry.register(spark)
    X.log_bodies(spark, sf_dir).createOrReplaceTempView("gm_bodies")
    return spark.sql(
        "SELECT request_id, wire_format(body) AS format, b.turn, b.role, classify_block(b.text) AS kind, sha2(distill_block(b.text, 'gpt').out, 256) AS out_sha "
        "FROM gm_bodies, LATERAL explode_blocks(body) b"
    )


def body_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations hold no machine output, so the engine returns them byte for byte."""
    made = X.bodies(spark, sf_dir)
    out = Engine(spark).apply(made).select("request_id", "format", "family", "blocks", F.sha2("body", 256).alias("body_sha"))
    return out


ROUNDTRIP_BODY = f"""SELECT conv_id, model, '{{"model":"' || model || '","messages":[' || items || ']}}' AS body FROM (SELECT conv_id, list_extract({X.MODELS}, (conv_id % {len(X.MODELS)} + 1)::INT) AS model,
  string_agg('{{"role":' || to_json(CASE role WHEN 'assistant' THEN 'tool' ELSE role END)::VARCHAR || ',"content":' || to_json(text)::VARCHAR || '}}', ',' ORDER BY turn) AS items FROM conversations GROUP BY conv_id)"""
ROUNDTRIP_SQL = f"""
SELECT conv_id AS request_id, 'openai_chat' AS format, CASE WHEN strlen(body) < 256 OR NOT (contains(body, 'tool') OR contains(body, '```') OR contains(body, 'diff --git')) THEN '' ELSE {texts.FAMILY_SQL} END AS family,
  0::BIGINT AS blocks, sha256(body) AS body_sha FROM ({ROUNDTRIP_BODY})"""


def shared_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set-level plan, each distinct block decided once."""
    out = Engine(spark).apply_shared(X.log_bodies(spark, sf_dir))
    return out.select("request_id", "blocks", F.sha2("body", 256).alias("body_sha"))


def request_log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log, summed by format."""
    results = Engine(spark).apply(X.log_bodies(spark, sf_dir).unionByName(X.bodies(spark, sf_dir).select((F.col("request_id") + 1_000_000_000).alias("request_id"), "body")))
    log = files.request_log(results, "2024-01-01T00:00:00Z")
    return log.groupBy("format").agg(F.count("*").alias("requests"), F.sum("original_bytes").alias("original_bytes"), F.sum(F.col("blocks").cast("long")).alias("blocks"), F.count_if(F.col("saved_pct") > 0).alias("saved_requests"))


REPORT_SQL = f"""{EXPECTED}, z AS (SELECT strlen(before) AS n, blocks, round(100.0::DOUBLE * (strlen(before) - strlen(after)) / strlen(before), 1) > 0 AS saved FROM k
  UNION ALL SELECT n, 0, false FROM (SELECT strlen(body) AS n FROM ({ROUNDTRIP_BODY})))
SELECT 'openai_chat' AS format, count(*) AS requests, sum(n)::BIGINT AS original_bytes, sum(blocks)::BIGINT AS blocks, count(*) FILTER (saved) AS saved_requests FROM z"""


def eval_cases(spark: SparkSession) -> DataFrame:
    """Three fixtures with facts that must stay and floors of saving: name, model, original, must_keep, min_pct."""
    suite = ["$ run suite --all"]
    for i in range(600):
        suite.append("--- FAIL: TestTotal (0.03s)\n    total_test.py:88: want 4200 got 420" if i == 137 else "--- FAIL: TestUndo (0.01s)\n    undo_test.py:12: undone twice" if i == 421 else "ok  shop/pay 0.42s" if i % 7 == 0 else "    pay_test.py:12: verbose padding padding padding padding ok")
    verbose = ["tests/api.py::test_login PASSED [  2%]"] * 300 + ["FAILED tests/pay.py::test_undo - assert 420 == 4200", "E       AssertionError: amount differs"] * 5 + ["tests/misc.py PASSED [ 99%]"] * 300
    server = [f"2026-01-02T10:{i // 60:02d}:{i % 60:02d}Z {'ERROR' if i % 250 == 0 else 'INFO'} request handled latency=12ms" for i in range(500)]
    rows = [
        ("suite", "gpt-5", "\n".join(suite) + "\n", ["--- FAIL: TestTotal", "want 4200 got 420", "undone twice", "$ run suite"], 80.0),
        ("verbose", "claude-sonnet-4", "\n".join(verbose) + "\n", ["FAILED tests/pay.py::test_undo", "AssertionError: amount differs"], 30.0),
        ("server", "deepseek-chat", "\n".join(server) + "\n", ["ERROR"], 70.0),
    ]
    return spark.createDataFrame(rows, "name string, model string, original string, must_keep array<string>, min_pct double")


def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case through the engine: which facts are missing, how much is saved, and whether it passes."""
    cases = eval_cases(spark)
    content = F.expr("substring(to_json(struct(original)), 13, length(to_json(struct(original))) - 13)")
    body = F.concat(F.lit('{"model":"'), "model", F.lit('","messages":[{"role":"user","content":"run"},{"role":"tool","content":'), content, F.lit("}]}"))
    results = Engine(spark).apply(cases.select(F.col("name").alias("request_id"), body.alias("body")))
    text = F.get_json_object("body", "$.messages[1].content")
    rows = cases.join(results, F.col("name") == F.col("request_id")).withColumn("text", text)
    rows = rows.withColumn("missing", F.filter("must_keep", lambda fact: ~F.contains(F.col("text"), fact))).withColumn("pct", N.saved_pct(F.col("original_bytes"), F.col("sent_bytes")))
    return rows.select("name", (F.col("blocks") > 0).alias("squeezed"), (F.size("missing") == 0).alias("kept"), (F.col("pct") >= F.col("min_pct")).alias("floor_met"), ((F.size("missing") == 0) & (F.col("pct") >= F.col("min_pct"))).alias("passes"))


EVAL_SQL = f"""WITH c AS (
SELECT 'suite' AS name, 'gpt-5' AS model, 'gpt' AS family, '$ run suite --all' || chr(10) || array_to_string(list_transform(range(600), lambda i: CASE WHEN i = 137 THEN '--- FAIL: TestTotal (0.03s)' || chr(10) || '    total_test.py:88: want 4200 got 420'
    WHEN i = 421 THEN '--- FAIL: TestUndo (0.01s)' || chr(10) || '    undo_test.py:12: undone twice' WHEN i % 7 = 0 THEN 'ok  shop/pay 0.42s' ELSE '    pay_test.py:12: verbose padding padding padding padding ok' END), chr(10)) || chr(10) AS text,
  ['--- FAIL: TestTotal', 'want 4200 got 420', 'undone twice', '$ run suite'] AS facts, 80 AS floor
UNION ALL SELECT 'verbose', 'claude-sonnet-4', 'claude', repeat('tests/api.py::test_login PASSED [  2%]' || chr(10), 300) || repeat('FAILED tests/pay.py::test_undo - assert 420 == 4200' || chr(10) || 'E       AssertionError: amount differs' || chr(10), 5)
  || repeat('tests/misc.py PASSED [ 99%]' || chr(10), 300), ['FAILED tests/pay.py::test_undo', 'AssertionError: amount differs'], 30
UNION ALL SELECT 'server', 'deepseek-chat', 'deepseek', array_to_string(list_transform(range(500), lambda i: '2026-01-02T10:' || lpad((i // 60)::VARCHAR, 2, '0') || ':' || lpad((i % 60)::VARCHAR, 2, '0') || 'Z '
  || CASE WHEN i % 250 = 0 THEN 'ERROR' ELSE 'INFO' END || ' request handled latency=12ms'), chr(10)), ['ERROR'], 70),
{texts._elided_sql("SELECT name AS user_id, family, text AS blob FROM c")},
z AS (SELECT name, floor, out <> text AS squeezed, len(list_filter(facts, lambda f: NOT contains(out, f))) = 0 AS kept, strlen('{{"model":"' || model || '","messages":[{{"role":"user","content":"run"}},{{"role":"tool","content":') + 3 AS frame,
  strlen(to_json(text)::VARCHAR) AS before, strlen(to_json(out)::VARCHAR) AS after FROM elided JOIN c ON name = user_id),
floors AS (SELECT *, round(100.0::DOUBLE * (before - after) / (frame + before), 1) >= floor AS floor_met FROM z)
SELECT name, squeezed, kept, floor_met, kept AND floor_met AS passes FROM floors"""


def _anthropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's log as tool results of two shapes in one conversation, and as plain text, which is not touched; every third as a body of another format."""
    text = F.to_json(F.struct(F.col("blob").alias("x")))
    content = F.expr("substring(text, 6, length(text) - 6)")
    model = F.element_at(F.array(*map(F.lit, X.MODELS)), (F.pmod("user_id", F.lit(len(X.MODELS))) + 1).cast("int"))
    rows = X.logs(spark, sf_dir).withColumn("text", text).withColumn("model", model)
    messages = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (_ANTHROPIC[0], F.col("model"), _ANTHROPIC[1], content, _ANTHROPIC[2], content, _ANTHROPIC[3], content, _ANTHROPIC[4])])
    other = F.concat(F.lit('{"model":"'), "model", F.lit('","tools":[],"input":'), content, F.lit("}"))
    return rows.select(F.col("user_id").alias("request_id"), F.when(F.pmod("user_id", F.lit(3)) == 2, other).otherwise(messages).alias("body"))


_ANTHROPIC = [
    '{"model":"', '","system":"s","messages":[{"role":"user","content":[{"type":"tool_result","tool_use_id":"a","content":', '}]},{"role":"assistant","content":"ok"},{"role":"user","content":[{"type":"text","text":"see"},'
    '{"type":"tool_result","tool_use_id":"b","content":[{"type":"image","source":"x"},{"type":"text","text":', "}]}]},{\"role\":\"user\",\"content\":", "}]}",
]


def anthropic_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, R2 on tool results given as text and as items: one is rewritten, the other refers to it; other formats pass through."""
    out = Engine(spark).apply(_anthropic(spark, sf_dir))
    return out.select("request_id", "format", "family", "original_bytes", "sent_bytes", "blocks", F.sha2("body", 256).alias("body_sha"), "error")


def _anthropic_sql(first: str, second: str) -> str:
    a = _ANTHROPIC
    return f"'{a[0]}' || model || '{a[1]}' || {first} || '{a[2]}' || {second} || '{a[3]}' || a || '{a[4]}'"


ANTHROPIC_SQL = f"""{EXPECTED}, others AS (SELECT *, user_id % 3 = 2 AS other, CASE WHEN strlen(blob) >= 512 THEN replace(again, 'turn 2 above', 'turn 1 above') ELSE again END AS later,
  '{{"model":"' || model || '","tools":[],"input":' || a || '}}' AS response FROM k),
y AS (SELECT *, CASE WHEN other THEN response ELSE {_anthropic_sql("a", "a")} END AS one, CASE WHEN other THEN response ELSE {_anthropic_sql("b", "to_json(later)::VARCHAR")} END AS two FROM others)
SELECT user_id AS request_id, CASE WHEN other THEN 'openai_responses' ELSE 'anthropic_messages' END AS format, CASE WHEN strlen(one) < 256 THEN '' ELSE family END AS family, strlen(one) AS original_bytes, strlen(two) AS sent_bytes,
  CASE WHEN other THEN 0 ELSE (out <> blob)::INT + (later <> blob)::INT END::BIGINT AS blocks, sha256(two) AS body_sha, NULL::VARCHAR AS error FROM y"""


def decisions_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose decisions are stored, and a second one, with another tag, that is served from them: what was sent once stays as it was."""
    made = X.log_bodies(spark, sf_dir)
    path = tables.new_path(spark, "decisions")
    first = Engine(spark)
    files.write_decisions(files.merge_decisions(first.decisions(first.apply(made), 1), capacity=1 << 30), path)
    again = Engine(spark, tag="another").apply_shared(made, files.read_decisions(spark, path))
    return again.select("request_id", "format", "blocks", "memo_hits")


RERUN_SQL = f"{EXPECTED} SELECT user_id AS request_id, 'openai_chat' AS format, blocks::BIGINT AS blocks, (2 * (out <> blob)::INT + (strlen(blob) < 512 AND out <> blob)::INT)::BIGINT AS memo_hits FROM k"


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any pass could change a document, a log or a JSON array."""
    return engine.gated(texts.mixed(spark, sf_dir), "id", "text")


GATE_VERDICT_SQL = f"""SELECT id, diff OR terminal OR (bracketed AND (prunable OR (id LIKE 'json-%' AND items >= 3))) OR kind IN ('test_output', 'log_output') AS gated
FROM ({texts.GATE_SQL}) JOIN ({texts.CLASSIFY_ALL_SQL}) USING (id) LEFT JOIN (SELECT 'json-' || user_id AS id, count(*) AS items FROM events GROUP BY user_id) USING (id)"""


def originals_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals appended in two runs, the second of which has all of the first again, and read back."""
    docs, path = X.table(spark, sf_dir, "documents"), tables.new_path(spark, "originals")
    files.append_originals(docs.filter("doc_id % 2 = 0"), path)
    files.append_originals(docs, path, files.read_originals(spark, path))
    back = spark.read.schema(S.ORIGINALS).json(path)
    return back.select("ref", F.octet_length("text").cast("long").alias("bytes"), (F.sha2("text", 256) == F.col("ref")).alias("resolves"))


APPEND_SQL = "SELECT DISTINCT sha256(text) AS ref, strlen(text) AS bytes, true AS resolves FROM documents"


def _streamed(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """``df`` as a stream of files, and paths of a sink and of its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = tables.new_path(spark, name)
    df.write.parquet(source)
    return spark.readStream.schema(df.schema).parquet(source), tables.new_path(spark, f"{name}-sink"), tables.new_path(spark, f"{name}-checkpoint")


def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as turns of one conversation a language, through the stream with state."""
    number = F.dense_rank().over(Window.orderBy("lang")).cast("long")
    langs = X.table(spark, sf_dir, "documents").select("lang").distinct().withColumn("conv_id", number)
    rows = X.table(spark, sf_dir, "documents").join(langs, "lang").select("conv_id", F.col("doc_id").alias("turn"), "text")
    stream, sink, checkpoint = _streamed(spark, rows, "turns")
    turns.dedup_stream(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(turns.OUTPUT).parquet(sink)
    return out.select("conv_id", "turn", "first_turn", F.sha2("deduped", 256).alias("deduped_sha"))


STREAM_SQL = f"""WITH {sets._DEDUP} SELECT r.conv_id, doc_id AS turn, first_turn, sha256(deduped) AS deduped_sha FROM d JOIN (SELECT lang, row_number() OVER (ORDER BY lang) AS conv_id FROM (SELECT DISTINCT lang FROM documents)) r USING (lang)"""


def engine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine on a stream of bodies."""
    stream, sink, checkpoint = _streamed(spark, X.log_bodies(spark, sf_dir), "bodies")
    turns.distil_stream(stream, Engine(spark), sink, checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("request_id", "format", "family", "original_bytes", "sent_bytes", "saved_bytes", "blocks", "memo_hits", "skipped", "error")


def savings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition: savings by family and pass, with totals."""
    results = Engine(spark).apply(X.log_bodies(spark, sf_dir)).select("family", F.explode("decisions").alias("d"))
    rows = results.select("family", F.col("d.pass").alias("pass"), (F.octet_length("d.text") - F.octet_length("d.out")).alias("saved"))
    return rows.rollup("family", "pass").agg(F.count("*").alias("blocks"), F.sum("saved").alias("saved_bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        wire_detect, explode_messages, user_wrapper_extract, request_results, anthropic_results, decisions_rerun, originals_of_results, originals_append, sql_functions, body_roundtrip, shared_plan, request_log_report, gate_verdict,
        eval_gate, savings_rollup, dedup_stream, engine_stream,
    )
}
SQL = {
    "wire_detect": WIRE_SQL, "explode_messages": EXPLODE_SQL, "user_wrapper_extract": WRAPPER_SQL, "body_roundtrip": ROUNDTRIP_SQL, "eval_gate": EVAL_SQL, "anthropic_results": ANTHROPIC_SQL, "decisions_rerun": RERUN_SQL,
    "request_results": RESULTS_SQL, "shared_plan": SHARED_SQL, "originals_of_results": ORIGINALS_SQL, "originals_append": APPEND_SQL, "savings_rollup": ROLLUP_SQL, "sql_functions": SQL_FUNCTIONS_SQL, "request_log_report": REPORT_SQL,
    "gate_verdict": GATE_VERDICT_SQL, "dedup_stream": STREAM_SQL, "engine_stream": RESULTS_SQL,
}
