"""Balanced contiguous shards from global byte-size prefix sums, in DataFrame operations only.

Rows are put in order of id (then text checksum and size) by a range partition; each
partition's byte and row totals make a small table with a row a partition, whose
running sums are the partitions' offsets.  A row's place is its partition's offset
plus the running sum inside the partition.  Shard k holds the rows whose byte midpoint
lies in [k, k+1) of ``shards`` equal parts of all bytes, so shards are contiguous and
differ from the target by less than the two rows at their ends.

The range partition is over ids, and over the place of a row in the input where all else is equal, and so does not depend on sources, groups of copies or
text lengths: no key gathers rows, not even one that a third of all rows share with equal texts.  Only ids, sizes and checksums are shuffled.

Defined cases.  A null text has no bytes, so its size is 1 and its checksum that of the
empty string.  Null ids come first.  Repeated rows each take a slot of their own; which of
two wholly equal rows comes first cannot be told apart.  An empty table gives no rows.
Fewer rows than shards leave shards empty.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import delete, stored


def placed(df: DataFrame, order: list[str], sizes: list[str], within: list[str] | None = None) -> tuple[DataFrame, str]:
    """``df`` with, for each column c of ``sizes``, c_before: its sum over all earlier rows in ``order``; ties are spread as they come.

    With ``within`` (leading columns of ``order``), sums restart for each of its values.
    A helper table holds a row for each partition (and value of ``within`` in it).  The path of
    the table that the result reads is returned too.
    """
    spark = df.sparkSession
    within = within or []
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that are equal in all of ``order`` are told apart by their places, so that many of them still are several ranges
    spread = [*order, "gm_tie"]
    dealt, path = stored(df.withColumn("gm_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *spread).withColumn("gm_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*within, "gm_part").agg(*[F.sum(c).alias(f"{c}_sum") for c in sizes])
    before = Window.partitionBy(*within).orderBy("gm_part").rowsBetween(Window.unboundedPreceding, -1)
    if within:
        crossing = totals.groupBy(*within).agg(F.min("gm_part").alias("gm_first"), F.max("gm_part").alias("gm_last")).filter("gm_first < gm_last")
        totals = totals.alias("t").join(crossing.alias("c"), [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in within], "left_semi")
    offsets = totals.select(*within, "gm_part", *[F.coalesce(F.sum(f"{c}_sum").over(before), F.lit(0)).alias(f"{c}_offset") for c in sizes])
    inside = Window.partitionBy("gm_part", *within).orderBy(*spread).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in sizes])
    keys = [*within, "gm_part"]
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    rows = rows.alias("r").join(offsets.alias("o"), same, "left")
    return rows.select(*[F.col(f"r.{c}") for c in df.columns], *[(F.col(f"{c}_inside") + F.coalesce(F.col(f"{c}_offset"), F.lit(0))).alias(f"{c}_before") for c in sizes]), path


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row of ``df``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("gm_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("gm_one"),
    )
    ranged, path = placed(rows, ["gm_id", "text_crc32", "size"], ["size", "gm_one"])
    known, _ = stored(ranged, "places")
    delete(df.sparkSession, path)
    total = known.agg(F.sum("size")).first()[0] or 1
    cut = known.withColumn("shard", F.expr(f"cast((2 * size_before + size) * {int(shards)}L div {2 * total}L as int)"))
    first = cut.groupBy("shard").agg(F.min("gm_one_before").alias("gm_first"))
    return cut.join(F.broadcast(first), "shard").select(
        F.col("gm_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("gm_one_before") - F.col("gm_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near equal bytes."""
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 is a fold over a text's bytes with a table of 256 remainders, which is made here from the polynomial.
OP3_SQL = """
WITH r AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM r),
d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, n + 1 AS size, list_transform(range(n), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM d),
x AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS text_crc32 FROM b, crc),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total,
  row_number() OVER (ORDER BY doc_id, text_crc32, size) AS n FROM x),
s AS (SELECT *, ((2 * before + size) * 16 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM s
"""
