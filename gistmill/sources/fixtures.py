"""Machine output derived from the plain tables, the same way in Spark and in SQL.

Rows are put in order by explicit keys before they are joined into a text, so results do not depend
on partitions.  A text is made of one user's events; it is an input of the distiller, which works
on whole texts, so a text is one value by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from gistmill.plans import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for queries that work on each text."""
    return tables.scan(spark, f"{sf_dir}/documents.parquet")


def grouped(df: DataFrame, key: str) -> GroupedData:
    """``df`` grouped by a key in as many tasks as the session shuffles to: what follows is heavier than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).groupBy(key)


def joined(value: Column, *order: Column, glue: str = "\n") -> Column:
    """An aggregate: the values in order, glued."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], value.alias("value"))))
    return F.array_join(F.transform(rows, lambda r: r["value"]), glue)


def event_k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1)


def event_time() -> Column:
    return F.substring(F.col("ts").cast("string"), 1, 19)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, event_id and line of every event."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(event_time(), F.lit(" "), level, F.lit(" "), "event_type", F.lit(" event="), F.col("event_id").cast("string"), F.lit(" k="), event_k())
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", line.alias("line"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and blob: a user's events as a log."""
    return grouped(log_lines(spark, sf_dir), "user_id").agg(joined(F.col("line"), F.col("ts"), F.col("event_id")).alias("blob"))


LOGS = """lines AS (SELECT user_id, ts, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' ' || event_type
  || ' event=' || event_id || ' k=' || regexp_extract(props, '([0-9]+)', 1) AS line FROM events),
logs AS (SELECT user_id, string_agg(line, chr(10) ORDER BY ts, event_id) AS blob FROM lines GROUP BY user_id)"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and doc: a user's events as a JSON array of objects with a constant member."""
    item = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"type":"'), "event_type", F.lit('","k":'), event_k(), F.lit(',"source":"web"}'))
    made = grouped(table(spark, sf_dir, "events"), "user_id").agg(joined(item, F.col("event_id"), glue=",").alias("items"), F.count("*").alias("n"))
    return made.select("user_id", "n", F.concat(F.lit("["), "items", F.lit("]")).alias("doc"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, model and body: conversations as chat requests, assistant turns relabelled ``tool`` for coverage."""
    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    message = F.to_json(F.struct(role.alias("role"), F.col("text").alias("content")))
    made = grouped(table(spark, sf_dir, "conversations"), "conv_id").agg(joined(message, F.col("turn"), glue=",").alias("items"))
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.pmod("conv_id", F.lit(len(MODELS))) + 1).cast("int"))
    return made.select(F.col("conv_id").alias("request_id"), model.alias("model"), F.concat(F.lit('{"model":"'), model, F.lit('","messages":['), "items", F.lit("]}")).alias("body"))


def log_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id and body: each user's log as the result of a tool, read twice in one conversation, and quoted by the user."""
    text = F.to_json(F.struct(F.col("blob").alias("x")))
    content = F.expr("substring(text, 6, length(text) - 6)")
    tool = F.concat(F.lit('{"role":"tool","content":'), content, F.lit("}"))
    quoted = F.concat(F.lit('{"role":"user","content":"see <tool_output>'), F.expr("substring(text, 7, length(text) - 8)"), F.lit('</tool_output> above"}'))
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.pmod("user_id", F.lit(len(MODELS))) + 1).cast("int"))
    rows = logs(spark, sf_dir).withColumn("text", text).withColumn("model", model)
    return rows.select(F.col("user_id").alias("request_id"), F.concat(F.lit('{"model":"'), "model", F.lit('","messages":[{"role":"user","content":"go"},'), tool, F.lit(","), tool, F.lit(","), quoted, F.lit("]}")).alias("body"))


MODELS = ["claude-sonnet-4", "gpt-5", "deepseek-chat", "o3-mini", "llama-3"]
