"""The engine: tables of request bodies in, distilled bodies and reports out.

``Engine.apply`` works a body where it is read: de-duplication across turns is inside one
body, so nothing is shuffled.  ``Engine.apply_shared`` is the set-level plan for corpora in which
the same blocks come back in many bodies (each turn of an agent repeats its history): every
distinct (family, text) is decided once, by text hash, and joined back.  Both give the same results.

Both take decisions of earlier runs, which then hold whatever the parameters say now, so that what was sent once stays as it
was: a block whose text has one is served from it and counted in ``memo_hits``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import schema as S
from gistmill.functions import bodies as B
from gistmill.functions import exact as E
from gistmill.functions import native as N
from gistmill.plans.tables import delete, small_batches, stored

_REPORT = {
    "format": pa.string(), "family": pa.string(), "original_bytes": pa.int64(), "sent_bytes": pa.int64(), "saved_bytes": pa.int64(), "blocks": pa.int64(),
    "memo_hits": pa.int64(), "transforms": pa.list_(pa.string()), "skipped": pa.bool_(), "skip_reason": pa.string(), "body": pa.string(), "error": pa.string(),
    "decisions": pa.list_(pa.struct([("text", pa.string()), ("out", pa.string()), ("pass", pa.string()), ("is_user", pa.bool_())])), "duration_ms": pa.float64(),
}
_REPORT_DDL = (
    "format string, family string, original_bytes long, sent_bytes long, saved_bytes long, blocks long, memo_hits long, transforms array<string>, "
    "skipped boolean, skip_reason string, body string, error string, decisions array<struct<text: string, out: string, pass: string, is_user: boolean>>, duration_ms double"
)
_BLOCK_DDL = "format string, model string, turn int, block_ix int, item_ix int, role string, is_user boolean, text string, byte_start int, byte_len int"


def _map_text(df: DataFrame, id_col: str, text_col: str, ddl: str, types: dict[str, pa.DataType], rows) -> DataFrame:
    """For each (id, text) of ``df``, the dicts that ``rows(text)`` gives, in batches."""
    small_batches(df.sparkSession)
    narrow = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("gm_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                place, found = [], []
                for i, value in enumerate(part.column(1)):
                    for row in rows(value.as_py()):
                        place.append(i)
                        found.append(row)
                columns = [pa.array([f[name] for f in found], kind) for name, kind in types.items()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place, pa.int64())), *columns], names=[id_col, *types])

    return narrow.mapInArrow(work, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {ddl}")


def explode_blocks(requests: DataFrame, id_col: str = "request_id", body_col: str = "body") -> DataFrame:
    """One row per block of every body, with its place in bytes."""
    types = {
        "format": pa.string(), "model": pa.string(), "turn": pa.int32(), "block_ix": pa.int32(), "item_ix": pa.int32(), "role": pa.string(), "is_user": pa.bool_(),
        "text": pa.string(), "byte_start": pa.int32(), "byte_len": pa.int32(),
    }
    return _map_text(requests, id_col, body_col, _BLOCK_DDL, types, B.exploded)


def wire_format(requests: DataFrame, id_col: str = "request_id", body_col: str = "body") -> DataFrame:
    """P3 over a table."""
    return _map_text(requests, id_col, body_col, "format string", {"format": pa.string()}, lambda body: [{"format": B.detect(body)}])


def classified(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """P7 over a table."""
    return _map_text(texts, id_col, text_col, "kind string", {"kind": pa.string()}, lambda t: [{"kind": E.classify(t or "")}])


def gated(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """P15, P16 over a table: whether any pass could change a text."""
    return _map_text(texts, id_col, text_col, "gated boolean", {"gated": pa.bool_()}, lambda t: [{"gated": E.gate(t or "")}])


def lifts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """J1, J2 over a table: path, rows and dropped_keys of what could become a table; one row of nulls where nothing can without loss."""
    types = {"path": pa.string(), "rows": pa.int64(), "dropped_keys": pa.list_(pa.string())}
    return _map_text(texts, id_col, text_col, "path string, rows long, dropped_keys array<string>", types, lambda t: [dict(zip(types, E.lift(t or "") or (None, None, None)))])


def distilled_user(texts: DataFrame, id_col: str, text_col: str, family: str = "generic", limits: S.Limits = S.Limits(), tag: str = S.TAG) -> DataFrame:
    """T12 over a table of user texts: id, out, pass."""
    rows = lambda t: [dict(zip(("out", "pass"), E.distill_user(t or "", family, limits, tag)))]
    return _map_text(texts, id_col, text_col, "out string, pass string", {"out": pa.string(), "pass": pa.string()}, rows)


def distilled(texts: DataFrame, id_col: str, text_col: str, family: str = "generic", limits: S.Limits = S.Limits(), tag: str = S.TAG, fold_ungated: bool = False) -> DataFrame:
    """T13 over a table of blocks: id, out, pass."""

    def rows(text: str | None) -> list[dict]:
        out, how = E.distill(text or "", family, limits, tag, fold_ungated)
        return [{"out": out, "pass": how}]

    return _map_text(texts, id_col, text_col, "out string, pass string", {"out": pa.string(), "pass": pa.string()}, rows)


def repeat_marker(first_turn: Column, size: Column, sha: Column, tag: str = S.TAG) -> Column:
    """What stands for a repeated text of ``size`` bytes with the hash ``sha``."""
    return N.worded(S.REPEATED, tag=F.lit(tag), turn=first_turn, size=size, ref=F.substring(sha, 1, S.REF_HEX))


def dedup_marks(blocks: DataFrame, group: str, turn: str, sha: str, size: str) -> DataFrame:
    """R1 on narrow rows: ``blocks``, of which ``sha`` and ``size`` tell the texts, with ``first_turn``, the first turn in which the group has the text.

    Null and short texts don't take part: their first turn is their own.  First turns are an aggregation, combined before it is shuffled, of which only
    texts that repeat are joined back; Spark splits that join where a text repeats very often.
    """
    long = F.col(size) >= S.DEDUP_FLOOR
    keyed = blocks.select(*[F.col(f"`{c}`") for c in blocks.columns], F.when(long, F.col(sha)).otherwise(F.xxhash64(turn, group).cast("string")).alias("gm_key"))
    first = blocks.filter(long).groupBy(F.col(group).alias("gm_group"), F.col(sha).alias("gm_sha")).agg(F.min(turn).alias("gm_first"), F.max(turn).alias("gm_last"))
    first = first.filter("gm_first < gm_last").drop("gm_last")
    found = keyed.join(first, F.col(group).eqNullSafe(F.col("gm_group")) & (F.col("gm_key") == F.col("gm_sha")), "left")
    return found.withColumn("first_turn", F.coalesce("gm_first", F.col(turn))).drop("gm_key", "gm_group", "gm_sha", "gm_first")


def dedup_blocks(blocks: DataFrame, group: str, turn: str, text: str, tag: str = S.TAG) -> DataFrame:
    """``first_turn`` and ``deduped`` of blocks: the text, or a reference to the same text in an earlier turn of the group."""
    rows = blocks.withColumn("gm_text_sha", F.sha2(F.col(text), 256)).withColumn("gm_size", F.octet_length(text))
    marked = dedup_marks(rows, group, turn, "gm_text_sha", "gm_size")
    marker = repeat_marker(F.col("first_turn"), F.col("gm_size"), F.col("gm_text_sha"), tag)
    return marked.withColumn("deduped", F.when(F.col(turn) > F.col("first_turn"), marker).otherwise(F.col(text))).drop("gm_text_sha", "gm_size")


_KEY = ["family", "is_user", "content_sha"]


class Engine:
    """Options, and the plans over tables of (request_id, body)."""

    def __init__(self, spark: SparkSession, limits: S.Limits = S.Limits(), tag: str = S.TAG):
        self.spark, self.limits, self.tag = spark, limits, tag

    def apply(self, requests: DataFrame, id_col: str = "request_id", body_col: str = "body", decisions: DataFrame | None = None, capacity: int = S.DECISION_CAPACITY) -> DataFrame:
        """Each body distilled, with its report; ``decisions`` has the texts that were replaced.

        Of given decisions, the ``capacity`` used last go to the workers.
        """
        limits, tag = self.limits, self.tag
        rows = [] if decisions is None else decisions.orderBy(F.desc("used"), *_KEY).limit(max(0, capacity)).select(*_KEY, "out", "pass").collect()
        held = self.spark.sparkContext.broadcast({tuple(r[:3]): (r[3], r[4]) for r in rows})
        return _map_text(requests, id_col, body_col, _REPORT_DDL, _REPORT, lambda body: [B.timed(B.apply, body, limits, tag, held.value)])

    def originals(self, results: DataFrame) -> DataFrame:
        """ref and text of everything that was replaced, each ref once.

        A text with escape sequences or carriage returns is kept under the ref of its cleaned form too, since that is what an elision
        marker names.
        """
        text = F.col("text")
        refs = F.array_distinct(F.array(F.sha2(text, 256), F.sha2(N.clean_returns(N.strip_ansi(text)), 256)))
        texts = results.select(F.explode("decisions").alias("d")).select(F.col("d.text").alias("text"))
        return texts.select(F.explode(refs).alias("ref"), "text").dropDuplicates(["ref"])

    def decisions(self, results: DataFrame, used: int) -> DataFrame:
        """Family, is_user, content_sha, out, pass and used of every block that was rewritten, or served, in ``results``: a run with the number ``used``.

        Blocks that were left as they are, and that other parameters would rewrite (a shorter tag saves more), are decisions as well: their ``out`` is the
        text and their ``pass`` is ``none``.  Bodies that were skipped have none.
        """
        rows = results.select("family", F.when(~F.col("skipped") & F.col("error").isNull(), F.col("body")).alias("body"), "decisions")
        small_batches(self.spark)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    got = [d for row in batch.slice(at, 256).to_pylist() for d in B.decided(row["family"], row["body"], row["decisions"])]
                    yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.bool_() if k == 1 else pa.string()) for k in range(5)], names=[*_KEY, "out", "pass"])

        made = rows.mapInArrow(work, "family string, is_user boolean, content_sha string, out string, pass string")
        return made.withColumn("used", F.lit(used).cast("long")).dropDuplicates(_KEY)

    def decide(self, blocks: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
        """(family, is_user, content_sha, out, pass, served) of each distinct ``text``; those in ``decisions`` are taken from it, and ``served``."""
        distinct = blocks.select("family", "is_user", F.sha2("text", 256).alias("content_sha"), "text").dropDuplicates(_KEY)
        if decisions is not None:
            distinct = distinct.join(decisions.select(*_KEY), _KEY, "left_anti")
        limits, tag = self.limits, self.tag
        small_batches(self.spark)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(E.distill_user if user else E.distill)(text, family, limits, tag) for family, user, _, text in zip(*[c.to_pylist() for c in batch.columns])]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[*_KEY, "out", "pass"]
                )

        fresh = distinct.mapInArrow(work, "family string, is_user boolean, content_sha string, out string, pass string").withColumn("served", F.lit(False))
        if decisions is None:
            return fresh
        asked = blocks.select("family", "is_user", F.sha2("text", 256).alias("content_sha")).distinct()
        return fresh.unionByName(decisions.join(asked, _KEY, "left_semi").select(*_KEY, "out", "pass", F.lit(True).alias("served")))

    def apply_shared(self, requests: DataFrame, decisions: DataFrame | None = None, id_col: str = "request_id", body_col: str = "body") -> DataFrame:
        """The results of ``apply``, deciding each distinct block once.

        Bodies are named by their hash, so those that repeat, under one id or many, are one.  Texts move to be decided and bodies to be put together; all else
        is joined by hash.
        """
        spark, tag, limits = self.spark, self.tag, self.limits
        rows = requests.select(F.col(f"`{id_col}`").alias("gm_id"), F.col(f"`{body_col}`").cast("string").alias("gm_text"), F.sha2(F.col(f"`{body_col}`").cast("string"), 256).alias("gm_body"))
        live = rows.filter(~N.body_too_large(F.col("gm_text"), limits) & ~N.bails_out(F.col("gm_text")))
        found, found_path = stored(explode_blocks(live, "gm_body", "gm_text").withColumn("family", N.family(F.col("model"))).withColumn("text_sha", F.sha2("text", 256)), "blocks")
        narrow = found.select("gm_body", "turn", "family", "is_user", "text_sha", F.octet_length("text").alias("size"), "byte_start", "byte_len").distinct()
        tools = dedup_marks(narrow.filter("not is_user"), "gm_body", "turn", "text_sha", "size")
        marked = tools.unionByName(narrow.filter("is_user").withColumn("first_turn", F.col("turn")))
        marker = F.when(F.col("turn") > F.col("first_turn"), repeat_marker(F.col("first_turn"), F.col("size"), F.col("text_sha"), tag))
        marked = marked.withColumn("marker", marker)
        made, made_path = stored(self.decide(found.select("family", "is_user", "text"), decisions), "decided")
        made = made.filter(F.sha2("out", 256) != F.col("content_sha")).select("family", "is_user", F.col("content_sha").alias("text_sha"), "out", "pass", "served")
        joined = marked.join(made, ["family", "is_user", "text_sha"], "left")
        repeat = F.struct("byte_start", "byte_len", F.col("marker").alias("out"), F.lit("repeat").alias("pass"), "is_user", F.lit(False).alias("served"))
        fresh = F.struct("byte_start", "byte_len", "out", "pass", "is_user", "served")
        change = F.when(F.col("marker").isNotNull(), repeat).when(F.col("out").isNotNull(), fresh)
        changes, _ = stored(joined.groupBy("gm_body").agg(F.collect_list(change).alias("changes")), "changes")
        delete(spark, found_path, made_path)
        ready = rows.join(changes, "gm_body", "left").select("gm_id", "gm_text", "changes")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    got = [B.timed(B.report, text, todo, limits) for text, todo in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([g[name] for g in got], kind) for name, kind in _REPORT.items()]], names=[id_col, *_REPORT])

        small_batches(spark)
        return ready.mapInArrow(work, f"`{id_col}` {requests.schema[id_col].dataType.simpleString()}, {_REPORT_DDL}")
