"""Queries over sets of blocks: repeats across turns, originals, decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.functions import native as N
from gistmill.plans import engine
from gistmill.sources import files
from gistmill.sources import fixtures as X


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents")


def content_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text, 256).alias("ref"), N.ref(text).alias("short_ref"))


CONTENT_REF_SQL = "SELECT doc_id, sha256(text) AS ref, left(sha256(text), 12) AS short_ref FROM documents"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as turns of one session a language, in order of doc_id: what stands for each, without texts."""
    rows = _docs(spark, sf_dir).select("lang", "doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("size"))
    marked = engine.dedup_marks(rows, "lang", "doc_id", "sha", "size")
    return marked.withColumn("marker", F.when(F.col("doc_id") > F.col("first_turn"), engine.repeat_marker(F.col("first_turn"), F.col("size"), F.col("sha"))))


def dedup_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each text, and digests of what is left of it."""
    sha, size = F.coalesce(F.sha2("marker", 256), "sha"), F.coalesce(F.octet_length("marker").cast("long"), "size")
    return _marked(spark, sf_dir).select("lang", "doc_id", "first_turn", sha.alias("deduped_sha"), size.alias("deduped_bytes"))


_DEDUP = f"""
f AS (SELECT lang, doc_id, text, CASE WHEN strlen(text) >= 512 THEN min(doc_id) OVER (PARTITION BY lang, sha256(text)) ELSE doc_id END AS first_turn FROM documents),
d AS (SELECT *, CASE WHEN doc_id > first_turn THEN '[... {S.TAG}: identical to the copy in turn ' || first_turn || ' above (' || strlen(text) || ' bytes) · ref ' || left(sha256(text), 12) || ' ...]' ELSE text END AS deduped FROM f)"""
DEDUP_TURNS_SQL = f"WITH {_DEDUP} SELECT lang, doc_id, first_turn, sha256(deduped) AS deduped_sha, strlen(deduped) AS deduped_bytes FROM d"


def dedup_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = F.coalesce(F.col("size") - F.octet_length("marker"), F.lit(0))
    return _marked(spark, sf_dir).groupBy("lang").agg(F.count("marker").alias("repeats"), F.sum("size").alias("original_bytes"), F.sum(saved).alias("saved_bytes"))


DEDUP_SAVINGS_SQL = f"WITH {_DEDUP} SELECT lang, count(*) FILTER (deduped <> text) AS repeats, sum(strlen(text))::BIGINT AS original_bytes, sum(strlen(text) - strlen(deduped))::BIGINT AS saved_bytes FROM d GROUP BY lang"


def originals_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text once.  What is asked of the texts here goes with their refs, so texts stay where they are."""
    sized = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("ref"), F.octet_length("text").cast("long").alias("bytes"))
    return files.put_originals(sized, text_col="bytes").select("ref", F.col("text").alias("bytes"))


ORIGINALS_SQL = "SELECT DISTINCT sha256(text) AS ref, strlen(text) AS bytes FROM documents"


def put_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of odd documents that no even document has."""
    docs = _docs(spark, sf_dir)
    have = files.put_originals(docs.filter("doc_id % 2 = 0"))
    return files.put_originals(docs.filter("doc_id % 2 = 1"), have).select("ref", F.octet_length("text").cast("long").alias("bytes"))


PUT_SQL = "SELECT DISTINCT sha256(text) AS ref, strlen(text) AS bytes FROM documents o WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = o.text)"


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents find their text by its full ref."""
    docs = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("ref"))
    kept = files.put_originals(_docs(spark, sf_dir))
    return docs.join(kept, "ref").select("doc_id", "ref", F.octet_length("text").cast("long").alias("bytes"))


LOOKUP_SQL = "SELECT doc_id, sha256(text) AS ref, strlen(text) AS bytes FROM documents"


def prefix_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of 2 to 12 digits, in upper case and with spaces, some of no text."""
    docs = _docs(spark, sf_dir)
    size = F.element_at(F.array(*map(F.lit, (2, 3, 4, 12))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    prefix = F.concat(F.lit(" "), F.upper(F.expr("substring(ref, 1, size)")), F.when(F.pmod("doc_id", F.lit(10)) == 9, "0f0f0f0f").otherwise(""))
    asked = docs.select("doc_id", F.sha2("text", 256).alias("ref"), size.alias("size")).select(prefix.alias("prefix")).distinct()
    kept = originals_store(spark, sf_dir)
    found = files.resolve_refs(asked, kept.withColumn("text_sha", F.col("ref")))
    return found.join(kept, "ref", "left").select("prefix", "status", "bytes")


RESOLVE_SQL = """
WITH d AS (SELECT doc_id, text, sha256(text) AS ref FROM documents),
a AS (SELECT DISTINCT ' ' || upper(left(ref, list_extract([2, 3, 4, 12], (doc_id % 4 + 1)::INT))) || CASE WHEN doc_id % 10 = 9 THEN '0f0f0f0f' ELSE '' END AS prefix FROM d),
o AS (SELECT DISTINCT ref, text FROM d),
h AS (SELECT prefix, count(ref) AS n, min(text) AS text FROM a LEFT JOIN o ON starts_with(ref, lower(trim(prefix))) GROUP BY prefix)
SELECT prefix, CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN n = 1 THEN strlen(text) END AS bytes FROM h"""


def decision_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blocks of two families, decided once each; what the even ones' decisions serve of all, and that rewrites are the same."""
    family = F.when(F.pmod(F.floor(F.col("doc_id") / 2), F.lit(2)) == 0, "gpt").otherwise("claude")
    blocks = X.texts(spark, sf_dir).select("doc_id", family.alias("family"), F.lit(False).alias("is_user"), "text")
    one = engine.Engine(spark)
    kept = one.decide(blocks.filter("doc_id % 2 = 0")).drop("served")
    made = one.decide(blocks, kept.withColumn("used", F.lit(1).cast("long")))
    uses = blocks.select("family", F.sha2("text", 256).alias("content_sha")).groupBy("family", "content_sha").agg(F.count("*").alias("blocks"))
    rows = made.join(uses, ["family", "content_sha"])
    return rows.groupBy("family", "served").agg(F.count("*").alias("decisions"), F.sum("blocks").alias("blocks"), F.count_if(F.sha2("out", 256) != F.col("content_sha")).alias("rewritten"))


REUSE_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN doc_id // 2 % 2 = 0 THEN 'gpt' ELSE 'claude' END AS family, sha256(text) AS s FROM documents),
g AS (SELECT family, s, count(*) AS n, bool_or(doc_id % 2 = 0) AS served FROM d GROUP BY ALL)
SELECT family, served, count(*) AS decisions, sum(n)::BIGINT AS blocks, 0::BIGINT AS rewritten FROM g GROUP BY family, served"""


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names or aliases, in either case, to the family they stand for, in order."""
    known = spark.createDataFrame([("claude", ["sonnet", "opus"]), ("gpt", ["openai", "o-series"]), ("deepseek", ["ds"])], "name string, aliases array<string>")
    terms = F.explode(F.array_union(F.array("name"), F.col("aliases")))
    table = known.select("name", terms.alias("term"))
    asked = X.table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, ("Claude", "DS", "o-Series", "unheard"))), F.pmod("n_nationkey", F.lit(4)) + 1).alias("asked"))
    return asked.join(F.broadcast(table), F.lower("asked") == F.col("term"), "left").select("n_nationkey", "asked", "name").orderBy("n_nationkey")


ALIAS_SQL = """
WITH a AS (SELECT n_nationkey, list_extract(['Claude', 'DS', 'o-Series', 'unheard'], n_nationkey % 4 + 1) AS asked FROM nation)
SELECT n_nationkey, asked, CASE lower(asked) WHEN 'claude' THEN 'claude' WHEN 'ds' THEN 'deepseek' WHEN 'o-series' THEN 'gpt' END AS name FROM a ORDER BY 1"""


QUERIES = {f.__name__: f for f in (content_ref, dedup_turns, dedup_savings, originals_store, put_if_absent, exact_lookup, prefix_resolve, decision_reuse, alias_lookup)}
SQL = {
    "content_ref": CONTENT_REF_SQL, "dedup_turns": DEDUP_TURNS_SQL, "dedup_savings": DEDUP_SAVINGS_SQL, "originals_store": ORIGINALS_SQL, "put_if_absent": PUT_SQL,
    "exact_lookup": LOOKUP_SQL, "prefix_resolve": RESOLVE_SQL, "decision_reuse": REUSE_SQL, "alias_lookup": ALIAS_SQL,
}
