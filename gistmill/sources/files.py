"""Sources and sinks: bodies, originals, decisions and the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.functions import native as N


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """One body a file, as request_id (its path) and body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("request_id"), F.col("value").alias("body"))


def read_originals(spark: SparkSession, path: str) -> DataFrame:
    """Ref and text of JSON lines; lines that don't parse or have no ref are left out, of a ref's lines one stays."""
    rows = spark.read.schema(S.ORIGINALS).option("mode", "DROPMALFORMED").json(path)
    return rows.filter((F.col("ref") != "") & F.col("ref").isNotNull()).groupBy("ref").agg(F.max("text").alias("text"))


def put_originals(texts: DataFrame, existing: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Ref and text of texts that ``existing`` does not have, each once; a column ``ref`` is taken as it is."""
    ref = F.col("ref") if "ref" in texts.columns else F.sha2(F.col(text_col), 256)
    fresh = texts.select(ref.alias("ref"), F.col(text_col).alias("text")).filter("text is not null").dropDuplicates(["ref"])
    return fresh if existing is None else fresh.join(existing.select("ref"), "ref", "left_anti")


def append_originals(texts: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    put_originals(texts, existing).write.mode("append").json(path)


def resolve_refs(refs: DataFrame, originals: DataFrame, ref_col: str = "prefix") -> DataFrame:
    """R6 on narrow rows: for each distinct prefix its status, and the least ref that starts with it if all of those name one text.

    ``originals`` has ref and text_sha, the hash of the text: a text may be kept under several refs.  Refs are cut to every length that the prefixes have
    (at most 64), so prefixes meet them by equality, not by comparing all pairs.
    """
    asked = refs.select(F.col(ref_col).alias("prefix")).distinct().withColumn("gm_prefix", F.lower(F.trim("prefix"))).withColumn("gm_size", F.length("gm_prefix"))
    sizes = asked.select("gm_size").distinct().filter("gm_size <= 64")
    cut = originals.select("ref", "text_sha").join(F.broadcast(sizes), F.length("ref") >= F.col("gm_size"))
    cut = cut.groupBy(F.expr("substring(ref, 1, gm_size)").alias("gm_prefix")).agg(F.min("ref").alias("ref"), F.min("text_sha").alias("gm_low"), F.max("text_sha").alias("gm_high"))
    hits = asked.join(cut, "gm_prefix", "left")
    status = F.when(F.col("ref").isNull(), "not_found").when(F.col("gm_low") != F.col("gm_high"), "ambiguous").otherwise("found")
    return hits.select("prefix", status.alias("status"), F.when(status == "found", F.col("ref")).alias("ref"))


def resolve(refs: DataFrame, originals: DataFrame, ref_col: str = "prefix") -> DataFrame:
    """For each distinct prefix, the text if all refs that start with it name one text: prefix, status, text."""
    found = resolve_refs(refs, originals.select("ref", F.sha2("text", 256).alias("text_sha")), ref_col)
    kept = found.filter("ref is not null").select("prefix", "ref").join(originals.select("ref", "text"), "ref")
    return found.select("prefix", "status").join(kept.select(F.col("prefix").alias("gm_prefix"), "text"), F.col("prefix") == F.col("gm_prefix"), "left").drop("gm_prefix")


def merge_decisions(fresh: DataFrame, kept: DataFrame | None = None, capacity: int = S.DECISION_CAPACITY) -> DataFrame:
    """``kept`` and ``fresh`` decisions, of which the ``capacity`` used last stay; a text's first decision holds.  With no capacity none stay."""
    key = ["family", "is_user", "content_sha"]
    both = fresh if kept is None else kept.unionByName(fresh)
    last = both.groupBy(*key).agg(F.min("used").alias("gm_first"), F.max("used").alias("gm_used"))
    last = last.orderBy(F.desc("gm_used"), *key).limit(max(0, capacity))
    rows = both.join(last, key).filter("used = gm_first").drop("used").withColumnRenamed("gm_used", "used")
    return rows.dropDuplicates(key).select(*key, "out", "pass", "used")


def write_decisions(decisions: DataFrame, path: str) -> None:
    """A run's decisions as a table of its own: a later run reads it and writes the next."""
    decisions.write.parquet(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DECISIONS).parquet(path)


def request_log(results: DataFrame, ts: str, method: str = "POST", path: str = "/v1/messages", status: Column | int = 200) -> DataFrame:
    """The log row of every result; ``status`` is that of the answer, which the engine does not see."""
    return results.select(
        F.lit(ts).alias("ts"), F.lit(method).alias("method"), F.lit(path).alias("path"), (F.lit(status) if isinstance(status, int) else status).cast("int").alias("status"), "format", "original_bytes", "sent_bytes",
        N.saved_pct(F.col("original_bytes"), F.col("sent_bytes")).alias("saved_pct"), F.col("blocks").cast("int").alias("blocks"), F.col("memo_hits").cast("int").alias("memo_hits"), "duration_ms",
    )


def latency(log: DataFrame) -> DataFrame:
    """Requests, and the median and 95th percentile of how long they took, by format."""
    return log.groupBy("format").agg(F.count("*").alias("requests"), F.percentile("duration_ms", 0.5).alias("median_ms"), F.percentile("duration_ms", 0.95).alias("p95_ms"))


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.REQUEST_LOG).json(path)
