"""A quality classifier from positive and unlabelled documents (non-negative PU learning).

Learning.  P is a bounded sample of documents that are labelled good; U a bounded sample of
all documents, whose labels are not looked at.  A small network g on shape features of
the text (shares of byte classes and symbols, repetition of words, word pairs and lines, lengths)
minimises the non-negative unbiased risk

    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))

with the logistic loss; when the second term falls below zero, its gradient is taken
upwards instead, which keeps the network from fitting U as all negative.  The class prior
is not given: a first classifier of P against U ranks held-back rows, and the prior is the
least ratio, over thresholds, of the (bounded) shares of U and of P above the threshold.
The score is the logistic function of g.

Both samples are of distinct (id, text) pairs, chosen by a hash of the pair: a threshold of 63 bits
that leaves about twice what is wanted, then the least hashes of those.  So they don't depend on
partitions, don't run empty in large tables, and are bounded exactly, whatever repeats.  Features are
made on the executors and only those of the samples reach the driver.

Defined cases.  Null and empty texts have zero features and are scored by them.  Rows of
labels with a null label or id don't count; an id with several labels counts as good if one
says so.  With fewer than two positive or unlabelled pairs the score is 0.5 for all.  Repeated rows are
learnt from once and give repeated results.  Texts are read whole, however long.  Empty tables give
empty results.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import delete, documents, id_and_text, small_batches, stored, texts, threshold
from gistmill.llm.langid import fold

#: Byte classes whose shares are features.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r", b".", b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b"<>", b"(){}[]", b"\"'", b":;", b"@/\\=+-_~^`", bytes(range(128, 256))]
_SHARE = np.array([[byte in c for byte in range(256)] for c in _CLASSES], dtype=np.float64)
SIZE = len(_CLASSES) + 9


def shape(text: bytes) -> np.ndarray:
    """The features of one text."""
    out = np.zeros(SIZE)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = counts / len(text)
    live = share[share > 0]
    words = text.split()
    lines = text.split(b"\n")
    n = max(1, len(words))
    # square roots spread small shares out
    out[: len(_CLASSES)] = np.sqrt(_SHARE @ share)
    out[len(_CLASSES) :] = (
        -float(live @ np.log2(live)) / 8,
        np.log1p(len(words)) / 10,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 1.0,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        np.log1p(len(lines)) / 10,
        len(set(lines)) / len(lines),
        min(5.0, len(text) / n / 10),
        min(5.0, np.log1p(max(map(len, words), default=0)) / 3),
    )
    return out


@dataclass(frozen=True)
class Model:
    """Means and scales of the features, and a network of one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def risks(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """prior * R_P(+1) and R_U(-1) - prior * R_P(-1), of which the second may be negative, from logits of P and of U."""
    return prior * float(np.logaddexp(0, -gp).mean()), float(np.logaddexp(0, gu).mean()) - prior * float(np.logaddexp(0, gp).mean())


def gradient(p: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, prior: float | None) -> dict[str, np.ndarray]:
    """The gradient, by each weight, of the non-negative risk of standardised rows ``a`` of P and ``b`` of U: that of both
    terms while the second is not negative, else that of minus the second.  With ``prior`` None, of telling P from U."""
    x = np.concatenate([a, b])
    h = np.maximum(x @ p["w1"] + p["b1"], 0)
    g = h @ p["w2"] + p["b2"][0]
    sp, su = _sigmoid(g[: len(a)]), _sigmoid(g[len(a) :])
    # loss(-1, g) = log(1 + e^g), its slope is sigmoid(g); loss(+1, g) has slope sigmoid(g) - 1
    if prior is None:
        d = np.concatenate([(sp - 1) / len(a), su / len(b)])
    elif risks(g[: len(a)], g[len(a) :], prior)[1] >= 0:
        d = np.concatenate([(prior * (sp - 1) - prior * sp) / len(a), su / len(b)])
    else:
        d = np.concatenate([prior * sp / len(a), -su / len(b)])
    dh = np.outer(d, p["w2"]) * (h > 0)
    return {"w1": x.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": np.array([d.sum()])}


def fit_network(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = 1500, hidden: int = 24, seed: int = 3) -> Model:
    """Minimise the non-negative PU risk; with ``prior`` None, tell P from U instead."""
    rng = np.random.default_rng(seed)
    mean, scale = unl.mean(0), unl.std(0) + 0.05
    p = {"w1": rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 0.3, hidden), "b2": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (pos, unl))
    for step in range(1, steps + 1):
        grad = gradient(p, zp[rng.integers(0, len(zp), 256)], zu[rng.integers(0, len(zu), 512)], prior)
        for k in p:
            pull = grad[k] + 1e-4 * p[k] if k[0] == "w" else grad[k]
            m[k] = 0.9 * m[k] + 0.1 * pull
            s[k] = 0.999 * s[k] + 0.001 * pull**2
            p[k] = p[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p["w1"], p["b1"], p["w2"], p["b2"], -1.0 if prior is None else prior)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in U: the least upper bound of U's share above a threshold over P's, on rows held back."""
    ranker = fit_network(pos[::2], unl[::2], None, steps=600)
    a, b = np.sort(ranker.logit(pos[1::2])), np.sort(ranker.logit(unl[1::2]))
    cuts = np.quantile(a, np.linspace(0, 0.9, 46))
    above = lambda v: 1 - np.searchsorted(v, cuts, "left") / len(v)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(a)) + 1 / np.sqrt(len(b)))
    bound = (above(b) + slack) / np.maximum(above(a), 1e-9)
    best = int(bound.argmin())
    return float(np.clip(above(b)[best] / max(above(a)[best], 1e-9), 0.02, 0.98))


def shapes(rows: DataFrame) -> DataFrame:
    """gm_shape instead of gm_text; every other column as it is."""
    names = [n for n in rows.columns if n != "gm_text"]
    place = rows.columns.index("gm_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "gm_text") + ", gm_shape array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shape(t).tolist() for t in texts(batch.column(place))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], found], names=[*names, "gm_shape"])

    return rows.mapInArrow(work, schema)


def _least(df: DataFrame, key: str, salt: str, total: int, wanted: int) -> DataFrame:
    """At most ``wanted`` distinct values of ``key``, those with the least hashes."""
    toss = F.xxhash64(F.col(key), F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1))
    rows = df.select(key, toss.alias("gm_toss")).filter(F.col("gm_toss") <= F.lit(threshold(total, wanted)))
    return rows.distinct().orderBy("gm_toss", key).limit(wanted).select(key)


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = 6000, max_unlabelled: int = 12_000) -> Model | None:
    """Learn from ``docs`` (the unlabelled population) and the ids in ``positives``; None without positives.

    At most ``max_positive`` and ``max_unlabelled`` distinct (id, text) pairs are learnt from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    keyed = rows.withColumn("gm_key", F.xxhash64("gm_id", "gm_text"))
    good = positives.select(F.col(f"`{id_col}`").alias("gm_id")).filter("gm_id is not null").distinct()
    chosen = _least(good, "gm_id", "positive", good.count(), max_positive)
    total = rows.count()
    below = F.xxhash64(F.col("gm_key"), F.lit("unlabelled")).bitwiseAND(F.lit((1 << 63) - 1)) <= F.lit(threshold(total, max_unlabelled))
    marked = keyed.join(F.broadcast(chosen.withColumn("gm_good", F.lit(True))), "gm_id", "left").select("gm_key", F.coalesce("gm_good", F.lit(False)).alias("gm_good"), below.alias("gm_unl"))
    # narrow and few: what either sample may draw from
    drawn, path = stored(marked.filter("gm_good or gm_unl").groupBy("gm_key").agg(F.max("gm_good").alias("gm_good"), F.max("gm_unl").alias("gm_unl")), "drawn")
    pos_keys = _least(drawn.filter("gm_good"), "gm_key", "positive", drawn.filter("gm_good").count(), max_positive).withColumn("gm_good", F.lit(True))
    unl_keys = _least(drawn.filter("gm_unl"), "gm_key", "unlabelled", 1, max_unlabelled).withColumn("gm_unl", F.lit(True))
    keys = pos_keys.join(unl_keys, "gm_key", "full").select("gm_key", F.coalesce("gm_good", F.lit(False)).alias("gm_good"), F.coalesce("gm_unl", F.lit(False)).alias("gm_unl"))
    sample = shapes(keyed.join(F.broadcast(keys), "gm_key").select("gm_key", "gm_good", "gm_unl", "gm_text"))
    got = sample.groupBy("gm_key").agg(F.first("gm_good"), F.first("gm_unl"), F.first("gm_shape")).collect()
    delete(spark, path)
    got = sorted(tuple(r) for r in got)
    pos = np.array([r[3] for r in got if r[1]])
    unl = np.array([r[3] for r in got if r[2]])
    if len(pos) < 2 or len(unl) < 2:
        return None
    shuffle = np.random.default_rng(5)
    pos, unl = shuffle.permutation(pos), shuffle.permutation(unl)
    return fit_network(pos, unl, estimate_prior(pos, unl))


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gm_id and score of every row."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    rows = id_and_text(df, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shape(t) for t in texts(batch.column(1))]).reshape(-1, SIZE)
            got = held.value.score(x) if held.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["gm_id", "score"])

    return rows.mapInArrow(work, f"gm_id {rows.schema['gm_id'].dataType.simpleString()}, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document; documents of fold 0 of 5 and their labels are held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").filter(fold("doc_id", 5) != 0)
    found = score(docs, fit(docs.filter(fold("doc_id", 5) != 0), labels))
    return found.select(F.col("gm_id").alias("doc_id"), (fold("gm_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
