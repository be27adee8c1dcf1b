"""Containment search against brute force."""

import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gistmill.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(docs, items, threshold=0.8):
    out = []
    for d, t in docs:
        s = shingles(t)
        for i, x in items:
            q = shingles(x)
            if q and len(q & s) >= threshold * len(q):
                out.append((d, i, len(q & s), len(q)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, shared int").repartition(2)
    return sorted(map(tuple, D.leaks(a, spark.createDataFrame(items, "item_id long, text string"), **options).collect()), key=str)


def test_tables_equal_sql(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert sorted(map(tuple, D.leaks(docs, items).collect())) == sorted(con.sql(D.OP2_SQL).fetchall()) != []


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)] + ["Éte", "ß", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 4, 5, 6, 7, 9, 12, 16, 30, 60, 200])]
    docs = []
    for i in range(150):
        parts = [text(rng.choice([0, 3, 40, 900]))]
        for _ in range(rng.randint(0, 3)):
            held = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                held[rng.randrange(len(held))] = "changed"
            parts += [" ".join(held).upper() if rng.random() < 0.3 else "\n".join(held) + ".", text(rng.choice([1, 20]))]
        docs.append((i, " ".join(parts)))
    docs.append((500, text(60_000) + " " + items[9][1] + " " + text(60_000)))
    return docs, items


def test_short_items_in_long_texts(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert run(spark, docs, items) == want and {w[1] for w in want} >= {3, 4, 9, 10}
    assert run(spark, docs, items, block_bytes=600) == want  # items in blocks


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (None, "one two three four five six"), (4, "x" * 3_000_000 + " tiny"), (5, "tiny"), (5, "tiny")]
    items = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, "!!"), (None, "Tiny"), (9, "x" * 3_000_000 + " tiny")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    a = spark.createDataFrame(docs, "doc_id long, text string")
    clean = D.clean(a, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == [(1, None), (2, ""), (3, "...")] and clean.schema == a.schema


def test_ids_of_any_type_and_repeated_items(spark):
    docs, items = corpus()
    want = brute(docs, items)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    for kind in ("smallint", "tinyint", "decimal(20,0)", "double", "string", "binary", "date"):
        column = F.expr("date_add(date'2000-01-01', cast(item_id as int))") if kind == "date" else F.col("item_id").cast("string").cast("binary") if kind == "binary" else F.col("item_id").cast(kind)
        b = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", column)
        assert D.leaks(a, b).count() == len(want) and D.leaks(a, b).schema["item_id"].dataType == b.schema["item_id"].dataType
    many = [(100 * n + i, t) for i, t in items for n in range(40)]
    got = run(spark, docs, many, block_bytes=4000)
    assert len(got) == 40 * len(want) and {(d, i % 100, x, y) for d, i, x, y in got} == set(want)
    assert len(list(D._blocks(spark.createDataFrame(many, "item_id long, text string"), "text", 1 << 20))[0]) == len(items)


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(20_000)})
    data = np.frombuffer(" ".join(words * 2).encode(), dtype=np.uint8)
    hashes, starts = D.word_hashes(data)
    assert len(hashes) == 2 * len(words) and len(set(hashes.tolist())) == len(words) and (hashes[: len(words)] == hashes[len(words) :]).all() and starts[0] == 0


def test_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = D.leaks(docs, items).select("doc_id").distinct()
    assert D.clean(docs, items).count() == docs.count() - bad.count()
    assert D.clean(docs, items).join(bad, "doc_id").count() == 0
    assert D.clean(docs, items.withColumn("text", F.lit("no such words are there in any of these"))).count() == docs.count()
