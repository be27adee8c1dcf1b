"""Queries on JSON and diffs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.plans import engine, tables
from gistmill.sources import fixtures as X

_K = "regexp_extract(props, '([0-9]+)', 1)"


def json_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1-J8 on an array of objects: a table with the constant member in its headline."""
    return engine.distilled(X.arrays(spark, sf_dir), "user_id", "doc").select("user_id", "out", "pass")


JSON_LIFT_SQL = f"""
WITH e AS (SELECT *, {_K} AS k FROM events),
g AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, min(event_type) AS one_type, count(DISTINCT k) AS ks, min(k) AS one_k,
  string_agg('{{"event_id":' || event_id || ',"type":"' || event_type || '","k":' || k || ',"source":"web"}}', ',' ORDER BY event_id) AS items,
  string_agg('| ' || event_id || ' | ' || event_type || ' | ' || k || ' |', chr(10) ORDER BY event_id) AS body FROM e GROUP BY user_id)
SELECT user_id, '[... {S.TAG} table: ' || n || ' rows · all rows: source=web ...]' || chr(10) || '| event_id | type | k |' || chr(10) || '|---|---|---|' || chr(10) || body || chr(10) AS out, 'table' AS pass FROM g
WHERE n >= 3 AND types > 1 AND ks > 1"""


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.arrays(spark, sf_dir).select("user_id", F.concat(F.lit('{"object":"list","total":'), F.col("n").cast("string"), F.lit(',"rate":0.50,"has_more":false,"next":null,"etag":"x","data":'), "doc", F.lit("}")).alias("doc"))


def envelope_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline of a wrapped array, with its scalar siblings."""
    return engine.distilled(_wrapped(spark, sf_dir), "user_id", "doc").select("user_id", F.substring_index("out", "\n", 1).alias("headline"), "pass")


ENVELOPE_SQL = f"""
WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, '[... {S.TAG} table: ' || n || ' rows · from "data" · object=list · total=' || n || ' · rate=0.5 · has_more=false · all rows: source=web ...]' AS headline, 'table' AS pass FROM e"""


def hoist_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 natively, for a known schema: columns whose value is the same and present in all of a user's rows."""
    rows = X.table(spark, sf_dir, "events").select("user_id", F.explode(F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), X.event_k(), F.lit("source"), F.lit("web"), F.lit("odd"), F.when(F.pmod("event_id", F.lit(2)) == 1, "odd"))).alias("column", "value"))
    grouped = rows.groupBy("user_id", "column").agg(F.count("value").alias("present"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return grouped.select("user_id", "column", ((F.col("present") == F.col("n")) & (F.col("low") == F.col("high")) & (F.col("n") >= 2)).alias("constant"))


HOIST_SQL = f"""
WITH e AS (SELECT user_id, unnest([{{'c': 'type', 'v': event_type}}, {{'c': 'k', 'v': {_K}}}, {{'c': 'source', 'v': 'web'}}, {{'c': 'odd', 'v': CASE WHEN event_id % 2 = 1 THEN 'odd' END}}]) AS m FROM events)
SELECT user_id, m.c AS "column", coalesce(count(m.v) = count(*) AND min(m.v) = max(m.v) AND count(*) >= 2, false) AS constant FROM e GROUP BY ALL"""


def json_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, metadata and empty members go, members stand in order of their names."""
    k = X.event_k()
    doc = F.concat(
        F.lit('{"zeta": "<'), "event_type", F.lit('>", "etag": "abc", "gone": null, "empty": { }, "list": [1, null, {"x": null}], "k": '), k, F.lit(', "deep": {"trace_id": "t", "inner": []}, "id": '), F.col("event_id").cast("string"), F.lit("}")
    )
    rows = tables.scan(spark, f"{sf_dir}/events.parquet").select("event_id", doc.alias("doc"))
    return engine.distilled(rows, "event_id", "doc").select("event_id", "out", "pass")


JSON_PRUNE_SQL = f"""SELECT event_id, '{{"id":' || event_id || ',"k":' || {_K} || ',"list":[1,{{}}],"zeta":"\\u003c' || event_type || '\\u003e"}}' AS out, 'prune' AS pass FROM events"""


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays two levels down, in turn: alone; beside a scalar, which no headline would show; and beside a nested member.

    The remainder has the sign of the id, as in the SQL, so ids below zero have the first form or the last.
    """
    n, shape = F.col("n").cast("string"), F.col("user_id") % 3
    deep = F.concat(F.lit('{"response":{"total":'), n, F.lit(',"data":'), "doc", F.lit("}"))
    doc = F.when(shape == 0, F.concat(deep, F.lit(',"next":null}'))).when(shape == 1, F.concat(deep, F.lit(',"object":"list"}'))).otherwise(F.concat(F.lit('{"data":'), "doc", F.lit(',"meta":{"total":'), n, F.lit("}}")))
    return X.arrays(spark, sf_dir).select("user_id", doc.alias("doc"))


def json_lift_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array two levels down becomes a table; one whose siblings a headline would lose is refused."""
    return engine.distilled(_deep(spark, sf_dir), "user_id", "doc").select("user_id", "out", "pass")


_DEEP = f"""
WITH e AS (SELECT *, {_K} AS k FROM events),
g AS (SELECT user_id, count(*) AS n, '[' || string_agg('{{"event_id":' || event_id || ',"type":"' || event_type || '","k":' || k || ',"source":"web"}}', ',' ORDER BY event_id) || ']' AS a,
  string_agg('| ' || event_id || ' | ' || event_type || ' | ' || k || ' |', chr(10) ORDER BY event_id) AS body FROM e GROUP BY user_id),
d AS (SELECT user_id, n, body, CASE user_id % 3 WHEN 0 THEN '{{"response":{{"total":' || n || ',"data":' || a || '}},"next":null}}' WHEN 1 THEN '{{"response":{{"total":' || n || ',"data":' || a || '}},"object":"list"}}'
  ELSE '{{"data":' || a || ',"meta":{{"total":' || n || '}}}}' END AS doc FROM g)"""
JSON_DEEP_SQL = f"""{_DEEP}
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '[... {S.TAG} table: ' || n || ' rows · from "response.data" · total=' || n || ' · all rows: source=web ...]' || chr(10) || '| event_id | type | k |' || chr(10) || '|---|---|---|' || chr(10) || body || chr(10) ELSE doc END AS out,
  CASE WHEN user_id % 3 = 0 THEN 'table' ELSE 'none' END AS pass FROM d"""


def json_lift_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could become a table, of how many rows, and which keys of later rows its columns would drop."""
    extra = F.regexp_replace("doc", r'"event_id":([0-9]*[02468]),', '"event_id":$1,"even":true,"etag":"x",')
    odd = X.arrays(spark, sf_dir).select(F.concat(F.lit("array-"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit('[{"event_id":1,"type":"first"},'), F.expr("substring(doc, 2)")).alias("doc"))
    made = odd.withColumn("doc", extra).unionByName(_deep(spark, sf_dir).select(F.concat(F.lit("deep-"), F.col("user_id").cast("string")).alias("id"), "doc"))
    return engine.lifts(made, "id", "doc").select("id", "path", "rows", F.array_join("dropped_keys", ",").alias("dropped_keys"))


JSON_KEYS_SQL = f"""{_DEEP}
SELECT 'array-' || user_id AS id, '' AS path, count(*) + 1 AS rows, CASE WHEN bool_or(event_id % 2 = 0) THEN 'even,k,source' ELSE 'k,source' END AS dropped_keys FROM e GROUP BY user_id
UNION ALL SELECT 'deep-' || user_id, CASE WHEN user_id % 3 = 0 THEN 'response.data' END, CASE WHEN user_id % 3 = 0 THEN n END, CASE WHEN user_id % 3 = 0 THEN '' END FROM d"""

_NOTE = "ab|" * 30


def json_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are cut, escaped, numbers of all sizes, and nested, in a table of four rows an event."""
    number = F.pmod("event_id", F.lit(1000)) * 4
    same = '"price":0.50,"big":12345678,"tiny":0.00001,"flag":true,"none":null,"nest":{"b":[1,null,"x<y"],"a":{}},"origin":"a warehouse far to the north of here","path":"/var/lib/warehouse/incoming/of/the/north/and/the/far/south"'
    rows = [F.concat(F.lit('{"id":'), (number + i).cast("string"), F.lit(f',"note":"{_NOTE}{i}","line":"one\\ntwo {i}",{same}}}')) for i in range(4)]
    doc = F.concat(F.lit("["), F.concat_ws(",", *rows), F.lit("]"))
    return engine.distilled(tables.scan(spark, f"{sf_dir}/events.parquet").select("event_id", doc.alias("doc")), "event_id", "doc").select("event_id", "out", "pass")


JSON_CELLS_SQL = f"""
WITH r AS (SELECT event_id, string_agg('| ' || (event_id % 1000 * 4 + i) || ' | ' || left(replace('{_NOTE}', '|', chr(92) || '|'), 77) || '... | one two ' || i || ' | - |', chr(10) ORDER BY i) AS body
  FROM events, (SELECT unnest(range(4)) AS i) GROUP BY event_id)
SELECT event_id, '[... {S.TAG} table: 4 rows · all rows: price=0.5 · all rows: big=1.2345678e+07 · all rows: tiny=1e-05 · all rows: flag=true · all rows: nest={{"a":{{}},"b":[1,null,"x\\u003cy"]}} · all rows: origin=a warehouse far to the north of here · all rows: path=/var/lib/warehouse/incoming/of/the/north/and/the/far/south · 4 cells truncated to 80 chars ...]'
  || chr(10) || '| id | note | line | none |' || chr(10) || '|---|---|---|---|' || chr(10) || body || chr(10) AS out, 'table' AS pass FROM r"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff a document: all its words, one a line, before and after a change, and a lock file of 40 lines."""
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\n]+", " "), " ")
    lines = F.transform(words, lambda w: F.concat(F.lit(" "), w))
    lock = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("+dep-"), i.cast("string"), F.lit(" v1")))
    head = F.array(F.lit("diff --git a/src/a.py b/src/a.py"), F.lit("--- a/src/a.py"), F.lit("+++ b/src/a.py"), F.lit("@@ -1,26 +1,26 @@"))
    tail = F.concat(F.array(F.lit("diff --git a/go.sum b/go.sum"), F.lit("--- a/go.sum"), F.lit("+++ b/go.sum"), F.lit("-old v0")), lock)
    rows = X.texts(spark, sf_dir).select("doc_id", lines.alias("lines"))
    return rows.select("doc_id", F.array_join(F.concat(head, "lines", F.array(F.lit("-was"), F.lit("+is")), "lines", tail), "\n").alias("diff"))


def diff_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9-T11, on whole documents."""
    return engine.distilled(_diffs(spark, sf_dir), "doc_id", "diff").select("doc_id", "out", "pass")


DIFF_SQL = f"""
WITH w AS (SELECT doc_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' '), lambda x: ' ' || x) AS l,
  array_to_string(['diff --git a/go.sum b/go.sum', '--- a/go.sum', '+++ b/go.sum', '-old v0'] || list_transform(range(1, 41), lambda i: '+dep-' || i || ' v1'), chr(10)) AS lock FROM documents),
c AS (SELECT doc_id, lock, array_to_string(CASE WHEN len(l) > 8 THEN [l[1], l[2], '    [... {S.TAG}: ' || (len(l) - 4) || ' unchanged context lines elided ...]', l[-2], l[-1]] ELSE l END, chr(10)) AS ctx FROM w)
SELECT doc_id, array_to_string(['diff --git a/src/a.py b/src/a.py', '--- a/src/a.py', '+++ b/src/a.py', '@@ -1,26 +1,26 @@', ctx, '-was', '+is', ctx,
  '[... {S.TAG}: 44 lines of go.sum diff elided (+40/-1) · ref ' || left(sha256(lock), 12) || ' ...]'], chr(10)) AS out, 'diff' AS pass FROM c"""


QUERIES = {f.__name__: f for f in (json_lift, json_lift_deep, json_lift_keys, json_cells, envelope_fields, hoist_constants, json_prune, diff_compact)}
SQL = {
    "json_lift": JSON_LIFT_SQL, "json_lift_deep": JSON_DEEP_SQL, "json_lift_keys": JSON_KEYS_SQL, "json_cells": JSON_CELLS_SQL, "envelope_fields": ENVELOPE_SQL, "hoist_constants": HOIST_SQL,
    "json_prune": JSON_PRUNE_SQL, "diff_compact": DIFF_SQL,
}
