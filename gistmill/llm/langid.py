"""Language identification with a byte convolutional network written in numpy.

Model.  A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, the last padded
with zero bytes.  A window passes a byte embedding, convolutions of several widths,
max pooling over its positions, and a softmax layer.  A text's prediction is the
softmax of the mean log-probability of its windows, each weighted by its bytes.
All windows of a text count; nothing is cut off.

Inference.  Embedding and filters of neighbouring bytes fold into tables indexed by
byte pairs, so a convolution is one or two gathers a position.

Training.  Adam on a bounded sample: at most ``per_lang`` distinct rows of each of at most
``max_langs`` languages (the most frequent: rarer ones can't be predicted), those with the least hash of id, text and language among what a threshold of 63 bits leaves,
so the choice does not depend on partitions and runs empty at no size; from each row two crops, the second shorter, so that short texts are known too.  Only
the sample reaches the driver.

Defined cases.  A text that is null or has no Unicode letter is ``und`` with score 0.  If
there is nothing to learn from, all texts are.  Repeated rows and ids give repeated
results; other columns are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.common import documents, id_and_text, runs, small_batches, texts, threshold

WINDOW = 512
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Model:
    """Weights: ``embed`` (256, d), per width ``conv`` (width, d, filters) and ``bias``, then ``out`` and ``out_bias``."""

    langs: tuple[str, ...]
    embed: np.ndarray
    conv: tuple[np.ndarray, ...]
    bias: tuple[np.ndarray, ...]
    out: np.ndarray
    out_bias: np.ndarray


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def train(crops: list[bytes], labels: list[int], langs: tuple[str, ...], filters: int = 16, dim: int = 8, steps: int = 600, seed: int = 7) -> Model:
    """Fit the network on byte strings of at most WINDOW bytes."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(crops), WINDOW), dtype=np.uint8)
    for row, crop in zip(x, crops):
        row[: len(crop)] = np.frombuffer(crop, dtype=np.uint8)
    y = np.array(labels)
    p = {"embed": rng.normal(0, 0.3, (256, dim))}
    for w in WIDTHS:
        p[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * dim), (w * dim, filters))
        p[f"bias{w}"] = np.zeros(filters)
    p["out"], p["out_bias"] = rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))), np.zeros(len(langs))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(-(-steps * 64 // len(x))):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            xb, yb = x[pick], y[pick]
            rows = np.arange(len(pick))
            used = max(max(WIDTHS), int((xb != 0).any(0).nonzero()[0].max(initial=0)) + 1)
            xb = xb[:, :used]
            e = p["embed"][xb]
            pooled, kept = [], []
            for w in WIDTHS:
                n = used - w + 1
                col = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
                z = col @ p[f"conv{w}"]
                arg = z.argmax(1)
                top = np.take_along_axis(z, arg[:, None], 1)[:, 0] + p[f"bias{w}"]
                pooled.append(np.maximum(top, 0))
                kept.append((col, arg, top > 0))
            h = np.concatenate(pooled, 1)
            logit = h @ p["out"] + p["out_bias"]
            logit -= logit.max(1, keepdims=True)
            prob = np.exp(logit)
            prob /= prob.sum(1, keepdims=True)
            prob[rows, yb] -= 1
            prob /= len(pick)
            g = {"out": h.T @ prob, "out_bias": prob.sum(0), "embed": np.zeros_like(p["embed"])}
            dh = prob @ p["out"].T
            for i, w in enumerate(WIDTHS):
                col, arg, live = kept[i]
                d = dh[:, i * filters : (i + 1) * filters] * live
                patch = col[rows[:, None], arg]
                g[f"conv{w}"] = np.einsum("bfk,bf->kf", patch, d)
                g[f"bias{w}"] = d.sum(0)
                back = (d[:, :, None] * p[f"conv{w}"].T[None]).reshape(len(pick), filters, w, dim)
                for j in range(w):
                    np.add.at(g["embed"], xb[rows[:, None], arg + j].ravel(), back[:, :, j].reshape(-1, dim))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= (0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(
        langs, p["embed"], tuple(p[f"conv{w}"].reshape(w, dim, filters) for w in WIDTHS), tuple(p[f"bias{w}"] for w in WIDTHS), p["out"], p["out_bias"]
    )


class Scorer:
    """A model with its byte-pair tables."""

    def __init__(self, model: Model):
        self.model = model
        self.plans = []
        for conv in model.conv:
            one = [model.embed @ conv[j] for j in range(len(conv))]
            plan = []
            for j in range(0, len(one) - 1, 2):
                plan.append((j, True, (one[j][:, None] + one[j + 1][None]).reshape(65536, -1).astype(np.float32)))
            if len(one) % 2:
                plan.append((len(one) - 1, False, one[-1].astype(np.float32)))
            self.plans.append((len(conv), plan))

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of each row of ``x`` (n, WINDOW)."""
        wide = x.astype(np.uint16)
        pair = (wide[:, :-1] << 8) | wide[:, 1:]
        feats = []
        for (w, plan), bias in zip(self.plans, self.model.bias):
            n = x.shape[1] - w + 1
            total = None
            for j, paired, table in plan:
                part = table.take((pair if paired else x)[:, j : j + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            feats.append(np.maximum(total.max(1) + bias, 0))
        logit = np.concatenate(feats, 1) @ self.model.out + self.model.out_bias
        logit -= logit.max(1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(1, keepdims=True))

    def texts(self, found: list[bytes]) -> tuple[list[str], list[float]]:
        counts = np.array([-(-len(t) // WINDOW) for t in found], dtype=np.int64)
        lives = [bool(n) and has_letter(t) for t, n in zip(found, counts)]
        owner = np.repeat(np.arange(len(found)), counts)
        data = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in found), dtype=np.uint8).reshape(-1, WINDOW)
        weight = np.minimum(WINDOW, np.array([len(t) for t in found])[owner] - WINDOW * (np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]))
        total = np.zeros((len(found), len(self.model.langs)))
        for at in range(0, len(data), 256):
            part = slice(at, at + 256)
            np.add.at(total, owner[part], self.windows(data[part]) * weight[part, None])
        langs, scores = [], []
        for live, row, t in zip(lives, total, found):
            if not live:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            row = np.exp((row - row.max()) / len(t))
            best = int(row.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(row[best] / row.sum()))
        return langs, scores


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1500, max_langs: int = 256) -> Model | None:
    """Train on the rows of ``df`` with a text and a language; None if there are none."""
    rows = df.select(F.col(f"`{id_col}`").alias("gm_id"), F.col(f"`{text_col}`").cast("string").alias("gm_text"), F.col(f"`{lang_col}`").cast("string").alias("gm_lang"))
    rows = rows.filter("gm_text is not null and gm_lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("gm_lang").count().orderBy(F.desc("count"), "gm_lang").limit(max_langs).collect()}
    if not counts:
        return None
    langs = tuple(sorted(counts))
    key = F.xxhash64("gm_id", "gm_text", "gm_lang")
    bound = F.create_map(*[F.lit(v) for lang in langs for v in (lang, threshold(counts[lang], per_lang))])
    toss = F.xxhash64(key, F.lit("langid")).bitwiseAND(F.lit((1 << 63) - 1))
    spot = F.pmod(F.xxhash64(key, F.lit("crop")), F.greatest(F.lit(1), F.length("gm_text") - WINDOW)).cast("int") + 1
    drawn = rows.filter(F.col("gm_lang").isin(*langs)).filter(toss <= bound[F.col("gm_lang")])
    drawn = drawn.select("gm_lang", toss.alias("toss"), F.substring("gm_text", spot, F.lit(WINDOW)).alias("crop"), F.pmod(key, F.lit(997)).alias("luck")).distinct()
    rank = F.row_number().over(Window.partitionBy("gm_lang").orderBy("toss", "crop"))
    got = sorted(tuple(r) for r in drawn.withColumn("n", rank).filter(F.col("n") <= per_lang).select("gm_lang", "crop", "luck").collect())
    crops, labels = [], []
    for lang, crop, luck in got:
        raw = crop.encode()[:WINDOW]
        short = raw[: max(12, int(len(raw) ** (0.45 + 0.5 * luck / 997)))]
        crops += [raw, short]
        labels += [langs.index(lang)] * 2
    return train(crops, labels, langs)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gm_id, lang_pred and score of every row."""
    small_batches(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value else None
        for batch in batches:
            found = list(texts(batch.column(1)))
            langs: list[str] = []
            scores: list[float] = []
            for a, b in runs([len(t) for t in found]):
                got = scorer.texts(found[a:b]) if scorer else ([UNDETERMINED] * (b - a), [0.0] * (b - a))
                langs += got[0]
                scores += got[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["gm_id", "lang_pred", "score"])

    kind = rows.schema["gm_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"gm_id {kind}, lang_pred string, score double")


def accepted(df: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang", min_score: float = 0.3) -> DataFrame:
    """The rows of ``df``, with all their columns, whose language is known: not ``und``, and with a score of at least
    ``min_score``.  A null language is filled in.  Without a model only texts without letters go."""
    small_batches(df.sparkSession)
    place, tag = df.columns.index(text_col), df.columns.index(lang_col)
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value else None
        for batch in batches:
            found = list(texts(batch.column(place)))
            keep: list[bool] = []
            langs: list[str | None] = []
            for a, b in runs([len(t) for t in found]):
                if scorer:
                    got, scores = scorer.texts(found[a:b])
                    keep += [g != UNDETERMINED and s >= min_score for g, s in zip(got, scores)]
                    langs += got
                else:
                    keep += [has_letter(t) for t in found[a:b]]
                    langs += [None] * (b - a)
            columns = list(batch.columns)
            columns[tag] = pa.array([x if x is not None else y for x, y in zip(columns[tag].to_pylist(), langs)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(work, df.schema)


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def learned(spark, sf_dir: str) -> Model | None:
    """The production model: learnt from documents whose fold is not the held-out one."""
    return fit(documents(spark, sf_dir).filter(fold("doc_id", 4) != 2))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document; documents of fold 2 of 4 are held out from training."""
    found = predict(documents(spark, sf_dir), learned(spark, sf_dir))
    return found.select(F.col("gm_id").alias("doc_id"), (fold("gm_id", 4) == 2).alias("held_out"), "lang_pred", "score")
