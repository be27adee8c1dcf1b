"""Native expressions against the exact operators, on texts that mix all the shapes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.functions import exact as E
from gistmill.functions import native as N

LINES = [
    "ERROR at x", "ok", "ok", "ok", "", " ", "--- FAIL: T", "fatal: y", "✗ bad", "2026-01-02T10:00:00Z INFO [a] handled it", "10:00:00 WARN late is the hour", "src/a.py:12:3: bad", "12:30: no", "a:b:",
    "PASS", "goroutine 7", "\x1b[31mred\x1b[0m", "1%\r2%\r ", "x\r", "plain words é ß", "ıError", "ſegmentation fault", "level=info", "E   assert", "\x1b]0;t\x07z", "\x1b[9",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        pool = rng.sample(LINES, rng.randint(1, 6))
        rows.append((i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 160)))))
    rows += [(1000, ""), (1001, "\n"), (1002, "\n\n\n\n\n"), (1003, "ERROR\n" * 400), (1004, "é" * 2000), (1005, ("z\n" * 200 + "ERROR e\n") * 3)]
    return spark.createDataFrame(rows, "id long, text string").cache()


def same(df, native, exact):
    got = df.select("text", native.alias("got")).collect()
    wrong = [(r.text, r.got, exact(r.text)) for r in got if r.got != exact(r.text)]
    assert not wrong, wrong[0]


@pytest.mark.parametrize("family", list(S.FAMILIES))
def test_elision(texts, family):
    same(texts, N.elided(F.col("text"), F.lit(family)), lambda t: E.elide(t, family) or t)


def test_elision_by_steps(spark, texts):
    """The projections give what the one expression gives, for texts of every number of lines about the bounds."""
    rows = [(2000 + n, "\n".join(["x" * 90] * n)) for n in range(70)]
    df = spark.createDataFrame(rows, "id long, text string").unionByName(texts)
    for family in S.FAMILIES:
        same(N.with_elision(df, "text", F.lit(family), "out"), F.col("out"), lambda t, family=family: E.elide(t, family) or t)


def test_terminal(texts):
    same(texts, N.strip_ansi(F.col("text")), E.strip_ansi)
    same(texts, N.clean_returns(F.col("text")), E.clean_returns)
    same(texts, N.fold_repeats(F.col("text")), E.fold_repeats)


def test_folding_is_linear(spark):
    """A million lines in one row, in runs and without any."""
    began = time.time()
    rows = [("\n".join(f"line {i // 5}" for i in range(1_000_000)),), ("\n".join(map(str, range(1_000_000))),)]
    df = spark.createDataFrame(rows, "text string")
    got = [r[0] for r in df.select(N.fold_repeats(F.col("text"))).collect()]
    assert got == [E.fold_repeats(t) for (t,) in rows] and time.time() - began < 40


def test_tokens_that_overlap(spark):
    """Counts are per token, also where one starts another or ends as it starts."""
    df = spark.createDataFrame([("aaaa abab ababa INFOINFO --- FAIL FAILED",), ("",), ("✓ ✗ ",)], "text string")
    for tokens in (["aa", "aba"], ["a", "ab"], S.LOG_LEVELS, S.TEST_TOKENS):
        same(df, N.token_count(F.col("text"), tokens), lambda t, tokens=tokens: sum(t.count(x) for x in tokens))


def test_classification(texts):
    def kind(t):
        k = E.classify(t)
        return k if k in ("test_output", "log_output") else "prose"

    plain = texts.filter(~F.col("text").rlike("(?m)^(package|import) "))
    same(plain, N.machine_kind(F.col("text")), kind)


def test_lines(spark, texts):
    lines = texts.select(F.explode(F.split("text", "\n")).alias("text")).distinct()
    same(lines, N.must_keep(F.col("text")), E.must_keep)
    same(lines, N.diagnostic(F.col("text")), E.is_diagnostic)
    same(lines, N.unified_diff(F.col("text")), E.is_diff)
    assert texts.select(N.ref(F.col("text")).alias("r"), "text").filter("id is not null").limit(3).count() == 3


def test_small_predicates(spark):
    rows = [("--- a/x\n+++ b/x",), ("--- x\n+++ y\n@@ -1",), ("--- x",), ('{"a": NULL}',), ("[ \t]",), ("[1]",), ('"\\u00e9"',), ("ETAG",), ('"\\U00"',)]
    df = spark.createDataFrame(rows, "text string")
    same(df, N.unified_diff(F.col("text")), E.is_diff)
    same(df, N.prunable(F.col("text")), E.is_prunable)
    paths = spark.createDataFrame([(p,) for p in ("a/b/Cargo.LOCK", "x.map", "map", "q.min.css", "q.css", "go.sum/x", "")], "text string")
    same(paths, N.generated_path(F.col("text")), E.is_generated)


def test_family(spark):
    from gistmill.functions.bodies import model_family

    df = spark.createDataFrame([(m,) for m in ("Claude-3", "my-gpt", "o1-x", "DeepSeek-o3", "llama", "")], "text string")
    same(df, N.family(F.col("text")), model_family)
    assert spark.range(1).select(N.family(F.lit(None).cast("string"))).first()[0] == "generic"
