"""Sharding and perspective rotation: laws, odd rows, and SQL for the latter."""

import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from gistmill.llm import perspectives as P
from gistmill.llm import sharding as G
from gistmill.plans import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shards", [1, 7, 16])
def test_shards(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(map(tuple, G.shard_by_bytes(docs, shards=shards).collect()))
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    total, before = sum(len(t) + 1 for t in text.values()), 0
    seen: dict[int, int] = {}
    for doc, size, crc, law, shard, slot, grown in rows:
        assert (size, crc, law, grown) == (len(text[doc]) + 1, zlib.crc32(text[doc]), "bytes", None)
        assert shard == (2 * before + size) * shards // (2 * total) and slot == seen.get(shard, 0)
        seen[shard] = slot + 1
        before += size
    assert len(rows) == len(text)


def test_shards_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, G.op3_sharding(spark, SF).collect())) == sorted(con.sql(G.OP3_SQL).fetchall())


def test_shards_of_odd_rows(spark):
    rows = [(None, None, 1), (None, "x", 1), (3, "é", 2), (3, "é", 2), (4, "", 0)] + [(9, "a" * 500_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long")
    got = G.shard_by_bytes(df).collect()
    assert len(got) == 6 and sorted(r["size"] for r in got) == [1, 1, 2, 3, 3, 500_001]
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert G.shard_by_bytes(df.limit(0)).count() == 0


def test_equal_rows_are_spread(spark):
    """Rows without ids and with one text are dealt to several ranges, and still have a slot each."""
    df = spark.createDataFrame([(None, "same")] * 4000 + [(i, "own") for i in range(50)], "doc_id long, text string").repartition(4)
    got = G.shard_by_bytes(df).collect()
    assert {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)} == {s: list(range(sum(r.shard == s for r in got))) for s in range(16)}
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 10
    narrow = df.select("doc_id", F.lit(5).cast("long").alias("n"))
    with tables.scope(spark):
        G.placed(narrow, ["doc_id"], ["n"])
        folder = next(x for x in os.listdir(tables.root(spark).removeprefix("file://")) if x.startswith("ranges"))
        parts = spark.read.parquet(f"{tables.root(spark)}/{folder}").groupBy("gm_part").count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 2000


def test_prefix_sums_within_groups(spark):
    """One group of most rows is spread over partitions and still sums up in order."""
    rows = [(1 if i % 10 else i, i, i % 7) for i in range(3000)] + [(None, i, 5) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, i long, n long").repartition(5)
    got = {(r.g, r.i): r.n_before for r in G.placed(df, ["g", "i"], ["n"], ["g"])[0].collect()}
    sums: dict = {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        assert got[(g, i)] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + n


def chats(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|> all"), (1, 2, "bob", "é"), (1, 3, "cy d", None), (1, 3, "cy d", None), (1, 4, "ann", ""), (2, 0, "system", "alone"),
        (3, 5, None, "who"), (3, None, "user", "first"), (None, 0, "user", "x" * 200_000), (None, 1, "assistant", "y"),
    ]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, start long")


def test_rotation(spark):
    rows = P.rotate(chats(spark)).collect()
    dialogues: dict = {}
    for r in sorted(rows, key=lambda r: r.start):
        key = (r.conv_id, r.perspective)
        text = dialogues.setdefault(key, "")
        assert r.start == len(text) and r.end == r.start + len(r.segment)
        dialogues[key] = text + r.segment
    assert set(dialogues) == {(1, "ann"), (1, "bob"), (1, "cy d"), (3, "unknown"), (3, "user"), (None, "user"), (None, "assistant")}
    cy = "cy_d-" + hashlib.md5(b"cy d").hexdigest()[:8]
    assert dialogues[1, "bob"] == (
        "<|im_start|>system\nrules<|im_end|>\n<|im_start|>user name=ann\nhi <\\|im_end|> all<|im_end|>\n<|im_start|>assistant\né<|im_end|>\n"
        f"<|im_start|>user name={cy}\n<|im_end|>\n<|im_start|>user name={cy}\n<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    )
    learnt = {(r.perspective, dialogues[r.conv_id, r.perspective][r.mask_start : r.mask_end]) for r in rows if r.mask_start is not None and r.conv_id == 1}
    assert learnt == {("ann", "hi <\\|im_end|> all<|im_end|>"), ("ann", "<|im_end|>"), ("bob", "é<|im_end|>"), ("cy d", "<|im_end|>")}
    assert P.rotate(chats(spark).limit(0)).count() == 0


def test_names_that_differ_in_marks_only(spark):
    df = spark.createDataFrame([(1, i, role, "x") for i, role in enumerate(["a b", "a_b", "a\tb", "A b", "me"])], "conv_id long, turn long, role string, text string")
    heads = [r.segment.split("\n")[0] for r in P.rotate(df).filter("perspective = 'me' and role = 'user'").collect()]
    assert len(set(heads)) == 4 and "<|im_start|>user name=a_b" in heads


@pytest.mark.parametrize("chunk", [1, 40, 1 << 16])
def test_rendered_dialogues(spark, chunk):
    """Chunks put together are the dialogue, and their masks are the ranges that are learnt from."""
    rows = P.rotate(chats(spark))
    whole, masks = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.start):
        key = (r.conv_id, r.perspective)
        whole[key] = whole.get(key, "") + r.segment
        masks.setdefault(key, []).extend([(r.mask_start, r.mask_end)] if r.mask_start is not None else [])
    got, found = {}, {}
    for r in sorted(P.render(rows, chunk).collect(), key=lambda r: r.start):
        key = (r.conv_id, r.perspective)
        assert r.start == len(got.get(key, "")) and r.start // chunk == r.chunk
        got[key] = got.get(key, "") + r.text
        found.setdefault(key, []).extend(tuple(map(int, m.split("-"))) for m in r.masks.split(",") if m)
    assert got == whole and found == masks


def test_rotation_equals_sql(spark):
    con = duckdb.connect()
    made = chats(spark).select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("made", made)
    for view in ("SELECT * FROM made", f"SELECT * FROM '{SF}/conversations.parquet'"):
        con.sql(f"CREATE OR REPLACE VIEW conversations AS {view}")
        source = chats(spark) if "made" in view else spark.read.parquet(f"{SF}/conversations.parquet")
        got = sorted(map(tuple, P.render(P.rotate(source)).collect()), key=str)
        assert got == sorted(con.sql(P.OP8_SQL).fetchall(), key=str)
