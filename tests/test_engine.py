"""The engine over tables: contracts, both plans, stores, sources and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.functions import exact as E
from gistmill.plans import tables
from gistmill.plans.engine import Engine, classified, dedup_blocks, distilled, explode_blocks
from gistmill.sources import files
from gistmill.streaming import turns
from tests.test_exact import GO, anthropic, chat, diff, log, rows, suite


@pytest.fixture(scope="module")
def requests(spark):
    texts = [log(600), suite(), GO, diff(5), json.dumps(rows(60)), "words " * 200, "\x1b[1mx\x1b[0m\r\n" * 80]
    rng = random.Random(2)
    made = [(i, chat(*[(rng.choice(["tool", "user", "assistant"]), rng.choice(texts)) for _ in range(rng.randint(1, 6))], model=rng.choice(["gpt-5", "claude-x", "deepseek", "llama"]))) for i in range(40)]
    made += [(100, anthropic(suite())), (101, None), (102, ""), (103, "{oops"), (104, "[" * 50_000), (105, chat(("user", "<tool_output>" + log(500) + "</tool_output>"))), (106, chat(("tool", log(500)))), (106, chat(("tool", log(500))))]
    return spark.createDataFrame(made, "request_id long, body string").cache()


def test_results(spark, requests):
    got = Engine(spark).apply(requests).collect()
    assert len(got) == requests.count()
    for r in got:
        assert r.saved_bytes == r.original_bytes - r.sent_bytes and r.sent_bytes == E.size(r.body) and (r.blocks > 0) == (r.saved_bytes != 0)
    by = {r.request_id: r for r in got}
    assert by[101].body == by[102].body == "" and by[103].body == "{oops" and by[104].format == "unknown" and by[100].format == "anthropic_messages" and by[105].blocks == 1
    assert Engine(spark, S.Limits(max_body=10)).apply(requests).filter("skipped").count() == requests.filter("octet_length(body) > 10").count()


def reports(df):
    """Rows without the time they took, their lists in order."""
    rows = [r.asDict(recursive=True) for r in df.drop("duration_ms").collect()]
    for r in rows:
        r["decisions"] = sorted((d["text"], d["out"], d["pass"], d["is_user"]) for d in r["decisions"])
    return sorted(map(str, rows))


def test_plans_agree(spark, requests):
    """Deciding distinct blocks once gives the same results as working body by body, also for repeated, null, odd and bounded bodies."""
    for engine in (Engine(spark), Engine(spark, S.Limits(max_body=9000)), Engine(spark, S.Limits(max_block=8000, min_block=600), tag="cut")):
        with tables.scope(spark):
            assert reports(engine.apply(requests)) == reports(engine.apply_shared(requests))


def test_shared_plan_leaves_its_changes_only(spark, requests):
    import os

    before = set(os.listdir(tables.root(spark).removeprefix("file://")))
    with tables.scope(spark):
        assert Engine(spark).apply_shared(requests).count() == requests.count()
        assert [x.rpartition("-")[0] for x in set(os.listdir(tables.root(spark).removeprefix("file://"))) - before] == ["changes"]
    assert set(os.listdir(tables.root(spark).removeprefix("file://"))) == before


def exchanged(df):
    """The text columns that any exchange of the plan carries, and how many exchanges there are."""
    todo, found, n = [df._jdf.queryExecution().executedPlan()], set(), 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
            continue
        if "Exchange" in node.nodeName():
            n += 1
            out = node.output()
            found |= {out.apply(i).name() for i in range(out.size()) if out.apply(i).dataType().simpleString() == "string"}
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found, n


def test_texts_stay_out_of_exchanges(spark):
    from gistmill.operators import sets

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("prefix_resolve", "dedup_turns", "dedup_savings", "originals_store"):
            carried, n = exchanged(sets.QUERIES[name](spark, "/root/testdata/sf0.001"))
            assert n and not carried & {"text", "deduped", "body"}, (name, carried)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_do_not_matter(spark, requests):
    few = {tuple(r) for r in Engine(spark).apply(requests.coalesce(1)).select("request_id", "body", "blocks").collect()}
    many = {tuple(r) for r in Engine(spark).apply(requests.repartition(13)).select("request_id", "body", "blocks").collect()}
    assert few == many


def test_decisions_are_reused(spark, requests):
    engine = Engine(spark)
    blocks = explode_blocks(requests.filter("request_id < 40")).select(F.lit("gpt").alias("family"), "is_user", "text")
    first = engine.decide(blocks).drop("served")
    pinned = first.withColumn("out", F.lit("pinned"))
    assert {(r.out, r.served) for r in engine.decide(blocks, pinned.cache()).collect()} == {("pinned", True)}


def test_decisions_outlive_a_run(spark, requests, tmp_path):
    """A second run with other parameters serves what the first decided, in both plans, and counts it; no more than the capacity stays."""
    engine, later = Engine(spark), Engine(spark, tag="other")
    first = engine.apply(requests)
    files.write_decisions(files.merge_decisions(engine.decisions(first, 1)), str(tmp_path / "one"))
    kept = files.read_decisions(spark, str(tmp_path / "one"))
    assert kept.count() > 5
    for plan in (later.apply, later.apply_shared):
        again = plan(requests, decisions=kept)
        by = {(r.request_id, r.original_bytes): r for r in again.collect()}
        for r in first.collect():
            now = by[r.request_id, r.original_bytes]
            assert now.memo_hits == sum(d["pass"] != "repeat" for d in r.decisions) and now.blocks == r.blocks
            if all(d["pass"] != "repeat" for d in r.decisions):
                assert now.body == r.body
    # the least recently used go first; what is used again stays as it was
    fresh = engine.decisions(first.filter("request_id < 9"), 2)
    n = fresh.count()
    used = files.merge_decisions(fresh, kept, n + 1).collect()
    assert 0 < n < kept.count() and sorted(r.used for r in used) == [1] + [2] * n
    changed = kept.withColumn("out", F.lit("new")).withColumn("used", F.lit(7).cast("long"))
    assert {(r.out == "new", r.used) for r in files.merge_decisions(changed, kept).collect()} == {(False, 7)}
    assert files.merge_decisions(kept, None, 0).count() == 0 and later.apply(requests, decisions=kept, capacity=0).filter("memo_hits > 0").count() == 0


def test_blocks_left_alone_stay(spark, tmp_path):
    """What the first run sent as it was, as its marker would have saved too little, a run with a shorter tag does not rewrite."""
    lines = log(46).split("\n")
    near = next(t for n in range(400) if E.distill(t := "\n".join([*lines, "x" * n]), "gpt")[1] == "none" and E.distill(t, "gpt", tag="a")[1] == "elide")
    texts = [("tool", near), ("user", f"<tool_output>{near}</tool_output>"), ("tool", log(500)), ("tool", "plain words " * 90)]
    made = spark.createDataFrame([(i, chat(t, ("user", "tool"), model="gpt-5")) for i, t in enumerate(texts)] + [(9, chat(*texts, model="gpt-5"))], "request_id long, body string")
    engine, later = Engine(spark), Engine(spark, tag="a")
    first = engine.apply(made)
    files.write_decisions(files.merge_decisions(engine.decisions(first, 1)), str(tmp_path / "one"))
    kept = files.read_decisions(spark, str(tmp_path / "one"))
    assert sorted((r["pass"], r.is_user, r.content_sha == E.sha(r.out)) for r in kept.collect()) == [("elide", False, False), ("none", False, True), ("none", True, True)]
    sent = {r.request_id: (r.body, r.blocks) for r in first.collect()}
    assert sent != {r.request_id: (r.body, r.blocks) for r in later.apply(made).collect()}
    for plan in (later.apply, later.apply_shared):
        again = plan(made, decisions=kept).collect()
        assert {r.request_id: (r.body, r.blocks) for r in again} == sent and sorted(r.memo_hits for r in again) == [0, 0, 0, 1, 1]


def test_originals_resolve(spark, requests, tmp_path):
    engine = Engine(spark)
    kept = engine.originals(engine.apply(requests))
    path = str(tmp_path / "originals")
    files.append_originals(kept, path)
    files.append_originals(kept, path, files.read_originals(spark, path))
    (tmp_path / "originals" / "bad.json").write_text('{"ref": "", "text": "x"}\nnot json\n{"ref": "abc", "text": "y"}\n')
    back = files.read_originals(spark, path)
    assert back.count() == kept.count() + 1
    ref = kept.first()["ref"]
    asked = spark.createDataFrame([(ref,), (f" {ref[:10].upper()} ",), ("",), ("zz",), ("abc",)], "prefix string")
    got = {r.prefix: r.status for r in files.resolve(asked, back).collect()}
    assert got == {ref: "found", f" {ref[:10].upper()} ": "found", "": "ambiguous", "zz": "not_found", "abc": "found"}


def test_log_round_trip(spark, requests, tmp_path):
    out = files.request_log(Engine(spark).apply(requests), "2026-01-02T00:00:00Z")
    files.write_log(out, str(tmp_path / "log"))
    back = files.read_log(spark, str(tmp_path / "log"))
    plain = lambda df: sorted((str(r.asDict()) for r in df.drop("duration_ms").collect()))
    assert plain(back) == plain(out) and back.filter("duration_ms > 0").count() == out.count()
    told = {r.format: r for r in files.latency(back).collect()}
    assert sum(r.requests for r in told.values()) == out.count() and all(0 < r.median_ms <= r.p95_ms for r in told.values())
    assert {r.status for r in files.request_log(Engine(spark).apply(requests), "t", status=F.when(F.col("error").isNull(), 201).otherwise(500)).collect()} <= {201, 500}


def test_bodies_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"messages":\n[]}')
    assert [r.body for r in files.bodies(spark, str(tmp_path)).collect()] == ['{"messages":\n[]}']


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "request_id long, body string")
    assert Engine(spark).apply(empty).count() == Engine(spark).apply_shared(empty).count() == 0
    odd = spark.createDataFrame([(None, None), (1, "")], "id long, text string")
    assert {r.pass_ for r in distilled(odd, "id", "text").withColumnRenamed("pass", "pass_").collect()} == {"none"}
    assert classified(odd, "id", "text").count() == 2


def test_dedup_by_turn(spark):
    text = "x" * 600
    df = spark.createDataFrame([(1, 1, text), (1, 1, text), (1, 3, text), (1, 4, "short"), (1, 5, "short"), (2, 9, text)], "conv_id long, turn long, text string")
    got = sorted((r.conv_id, r.turn, r.first_turn, r.deduped == r.text) for r in dedup_blocks(df, "conv_id", "turn", "text").collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (1, 3, 1, False), (1, 4, 4, True), (1, 5, 5, True), (2, 9, 9, True)]
    odd = spark.createDataFrame([(None, 1, text), (None, 2, text), (1, 3, None), (1, 4, None), (1, 5, "")], "conv_id long, turn long, text string")
    assert sorted(str(tuple(r)[:2] + (r.first_turn,)) for r in dedup_blocks(odd, "conv_id", "turn", "text").collect()) == ["(1, 3, 3)", "(1, 4, 4)", "(1, 5, 5)", "(None, 1, 1)", "(None, 2, 1)"]


def test_stream_equals_batch(spark, tmp_path):
    """Turns in order, batch by batch, give what the window gives over all; replayed turns change nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    texts = ["a" * 600, "b" * 700, "short"]
    made = [(c, t, texts[(c + t // 2) % 3]) for c in range(3) for t in range(6)]
    source = tmp_path / "in"
    df = spark.createDataFrame(made, "conv_id long, turn long, text string")
    for low in (0, 3):
        df.filter((F.col("turn") >= low) & (F.col("turn") < low + 3)).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(df.schema).json(str(source))
        query = turns.dedup_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {(r.conv_id, r.turn, r.deduped) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.conv_id, r.turn, r.deduped) for r in dedup_blocks(df, "conv_id", "turn", "text").collect()}
    assert got == want


def test_state_expires(spark, tmp_path):
    """Without a bound a text is known for good; with one, a copy that comes later is a first turn again."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    first = {}
    for name, ttl in (("kept", None), ("bounded", 1)):
        for turn in (1, 2):
            spark.createDataFrame([(7, turn, "t" * 600), (7, turn, None)], "conv_id long, turn long, text string").coalesce(1).write.mode("append").json(str(tmp_path / name / "in"))
            stream = spark.readStream.schema("conv_id long, turn long, text string").json(str(tmp_path / name / "in"))
            # one batch: with a clock running, a stream never has nothing left to do
            turns.dedup_stream(stream, ttl).writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "ck")).trigger(once=True).start().awaitTermination(60)
            time.sleep(1.5)
        rows = spark.read.parquet(str(tmp_path / name / "out")).collect()
        first[name] = sorted((r.turn, r.first_turn) for r in rows if r.text)
        assert sorted(r.turn for r in rows if r.text is None) == [1, 2]
    assert first == {"kept": [(1, 1), (2, 1)], "bounded": [(1, 1), (2, 2)]}


def test_engine_stream(spark, requests, tmp_path):
    requests.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    query = turns.distil_stream(stream, Engine(spark), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == requests.count()


def test_markers_resolve(spark):
    """Every ref in a marker of a distilled body finds the text that stood there."""
    import re

    dirty = log(600).replace("ERROR", "\x1b[31mERROR\x1b[0m").replace("\n", "\r\n")
    made = spark.createDataFrame([(1, chat(("tool", dirty), ("tool", log(500)), ("assistant", "a"), ("tool", log(500))))], "request_id long, body string")
    engine = Engine(spark)
    results = engine.apply(made).cache()
    refs = re.findall(r"(?:locally as|ref) ([0-9a-f]{12})", results.first()["body"])
    asked = spark.createDataFrame([(r,) for r in set(refs)], "prefix string")
    found = {r.text for r in files.resolve(asked, engine.originals(results)).collect()}
    assert len(refs) == 3 and found == {dirty, log(500)}


def test_sql_functions(spark):
    from gistmill.functions import registry

    registry.register(spark)
    deep = '{"messages":[],"x":' + '{"a":' * 900 + "1" + "}" * 901
    assert spark.createDataFrame([(9, deep)], "request_id long, body string").transform(explode_blocks).count() == 0
    spark.createDataFrame([(1, chat(("tool", log(600)), ("user", "é hello"))), (2, "{oops"), (3, None)], "id long, body string").createOrReplaceTempView("t")
    got = spark.sql("SELECT id, b.*, substring(encode(body, 'utf-8'), b.byte_start + 1, b.byte_len) AS raw FROM t, LATERAL explode_blocks(body) b").collect()
    assert [(r.id, r.turn, r.role, json.loads(bytes(r.raw))) for r in got] == [(1, 1, "tool", log(600)), (1, 2, "user", "é hello")]
    rows = spark.sql("SELECT id, wire_format(body) AS f, classify_block(body) AS k, distill_block(body, 'none').changed AS c FROM t ORDER BY id").collect()
    assert [r.f for r in rows] == ["openai_chat", "unknown", "unknown"] and rows[2].k is None and not rows[2].c


def test_small_functions(spark):
    from gistmill.functions import native

    row = spark.createDataFrame([("\ufeffÉABC",)], "t string").select(native.without_bom(F.col("t")).alias("a"), native.ascii_lower(F.col("t")).alias("b")).first()
    assert tuple(row) == ("ÉABC", "\ufeffÉabc")
