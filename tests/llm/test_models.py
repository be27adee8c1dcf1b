"""Language ID, quality and the tokenizer: held-out accuracy, the library's own results, odd rows."""

import itertools
import math
import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gistmill.llm import langid as L
from gistmill.llm import pieces as P
from gistmill.llm import quality as Q
from gistmill.llm.common import threshold

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = L.op10_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and 200 < len(held) < 300 and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert set(got[got.held_out].doc_id) == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    words = {"aa": ["alpha", "beta", "gamma"], "bb": ["über", "straße", "größe"]}
    crops = [" ".join(rng.choice(words[w]) for _ in range(20)).encode() for w in ("aa", "bb") for _ in range(60)]
    return L.train(crops, [0] * 60 + [1] * 60, ("aa", "bb"), steps=60)


def test_tables_equal_the_plain_network(model):
    """Inference by byte-pair tables is the network itself."""
    x = np.random.default_rng(1).integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    feats = []
    for conv, bias in zip(model.conv, model.bias):
        w, n = len(conv), x.shape[1] - len(conv) + 1
        z = sum(model.embed[x[:, j : j + n]] @ conv[j] for j in range(w))
        feats.append(np.maximum(z.max(1) + bias, 0))
    logit = np.concatenate(feats, 1) @ model.out + model.out_bias
    want = logit - logit.max(1, keepdims=True)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    assert np.allclose(L.Scorer(model).windows(x), want, atol=1e-3)


def test_scores_equal_a_plain_mean_over_windows(model):
    """Each text by itself: the plain network on every window, the mean of log-probabilities weighted by bytes, and its softmax."""
    rng = random.Random(3)
    found = ["alpha beta", "größe " * 300, "x", "gamma ßß " * 57 + "é", "".join(rng.choice("abß é") for _ in range(1024)) + "z", "12 ,", "", "b" * 512]
    langs, scores = L.Scorer(model).texts([t.encode() for t in found])
    for text, lang, score in zip(found, langs, scores):
        raw = text.encode()
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        total = np.zeros(2)
        for at in range(0, len(raw), L.WINDOW):
            window = np.frombuffer(raw[at : at + L.WINDOW].ljust(L.WINDOW, b"\0"), dtype=np.uint8)
            feats = []
            for conv, bias in zip(model.conv, model.bias):
                z = [sum(model.embed[window[i + j]] @ conv[j] for j in range(len(conv))) for i in range(L.WINDOW - len(conv) + 1)]
                feats.append(np.maximum(np.max(z, axis=0) + bias, 0))
            logit = np.concatenate(feats) @ model.out + model.out_bias
            total += (logit - np.log(np.exp(logit - logit.max()).sum()) - logit.max()) * len(raw[at : at + L.WINDOW])
        mean = np.exp(total / len(raw))
        assert lang == model.langs[int(mean.argmax())] and score == pytest.approx(mean.max() / mean.sum(), abs=1e-3)


def test_language_sample_is_bounded(spark):
    """One id for all rows of a language and rows that repeat: at most per_lang distinct rows of each language."""
    rows = [(1, f"alpha beta number {i}", "aa") for i in range(200)] + [(i, "gamma delta", "bb") for i in range(50)] + [(9, "same words", "cc")] * 90
    seen = []
    known, L.train = L.train, lambda crops, labels, langs, **k: seen.append([labels.count(i) for i in range(len(langs))])
    try:
        L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), per_lang=30)
        L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), per_lang=30, max_langs=2)
    finally:
        L.train = known
    assert seen == [[60, 60, 2], [60, 2]]


def test_language_of_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "alpha beta gamma alpha"), (4, "日"), (5, "größe straße über " * 40_000), (5, "größe straße über " * 40_000)]
    df = spark.createDataFrame([(*r, None, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = sorted(((r.gm_id, r.lang_pred) for r in L.predict(df, model).collect()), key=str)
    assert [g for g in got if g[0] != 4] == [(1, "und"), (2, "und"), (3, "und"), (5, "bb"), (5, "bb"), (None, "aa")]
    assert L.fit(df) is None and {r.lang_pred for r in L.predict(df, None).collect()} == {"und"}
    kept = L.accepted(df, model)
    assert kept.columns == df.columns and sorted(((r.doc_id, r.lang) for r in kept.collect() if r.doc_id != 4), key=str) == [(5, "bb"), (5, "bb"), (None, "aa")]
    assert L.accepted(df, None).count() == 4 and L.predict(df.limit(0), model).count() == 0


def test_quality_held_out(spark):
    got = Q.op7_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    for part in (got[got.held_out], got[~got.held_out]):
        good, bad = part[part.quality == 1].score.values, part[part.quality == 0].score.values
        assert np.mean(good[:, None] > bad[None]) > 0.97 and (part.predicted == part.quality).mean() > 0.9


def test_prior_and_risk():
    """With half of U negative, the prior is near one half and the network tells the halves apart."""
    rng = np.random.default_rng(2)
    pos, neg = rng.normal(1.5, 1, (3000, Q.SIZE)), rng.normal(-1.5, 1, (1500, Q.SIZE))
    prior = Q.estimate_prior(pos[:1500], np.concatenate([pos[1500:], neg]))
    assert 0.4 < prior < 0.6
    model = Q.fit_network(pos[:1500], np.concatenate([pos[1500:], neg]), prior, steps=400)
    assert (model.score(pos) > 0.5).mean() > 0.95 and (model.score(neg) < 0.5).mean() > 0.95


def test_risk_and_gradient_by_brute_force():
    """The risk by its formula, row by row, and its gradient by differences, on both sides of zero."""
    rng = np.random.default_rng(4)
    p = {"w1": rng.normal(0, 0.5, (Q.SIZE, 3)), "b1": rng.normal(0, 0.1, 3), "w2": rng.normal(0, 0.5, 3), "b2": np.array([0.2])}
    pool = rng.normal(0, 2, (400, Q.SIZE))
    pool = pool[np.argsort(np.maximum(pool @ p["w1"] + p["b1"], 0) @ p["w2"])]
    a, b = pool[-7:], pool[190:199]

    def logit(x, w):
        hidden = [max(0.0, sum(x[i] * w["w1"][i][j] for i in range(Q.SIZE)) + w["b1"][j]) for j in range(3)]
        return sum(h * v for h, v in zip(hidden, w["w2"])) + w["b2"][0]

    loss = lambda sign, g: math.log(1 + math.exp(-sign * g))
    mean = lambda v: sum(v) / len(v)
    signs = set()
    for prior in (0.05, 0.97):
        for rows_b in (b, pool[:9]):

            def terms(w):
                gp, gu = [logit(x, w) for x in a], [logit(x, w) for x in rows_b]
                return prior * mean([loss(1, g) for g in gp]), mean([loss(-1, g) for g in gu]) - prior * mean([loss(-1, g) for g in gp])

            gp, gu = (np.array([logit(x, p) for x in rows]) for rows in (a, rows_b))
            assert Q.risks(gp, gu, prior) == pytest.approx(terms(p))
            signs.add(terms(p)[1] >= 0)
            aim = lambda w: sum(terms(w)) if terms(p)[1] >= 0 else -terms(w)[1]  # noqa: E731, B023
            got = Q.gradient(p, a, rows_b, prior)
            for k, at in (("w1", (2, 1)), ("w1", (20, 0)), ("b1", (2,)), ("w2", (0,)), ("w2", (2,)), ("b2", (0,))):
                up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
                up[k][at] += 1e-6
                down[k][at] -= 1e-6
                assert got[k][at] == pytest.approx((aim(up) - aim(down)) / 2e-6, rel=1e-3, abs=1e-6)
    assert signs == {True, False}


def test_scores_equal_a_plain_network(spark):
    rng = np.random.default_rng(5)
    model = Q.Model(rng.random(Q.SIZE), rng.random(Q.SIZE) + 0.1, rng.normal(0, 0.3, (Q.SIZE, 4)), rng.normal(0, 0.1, 4), rng.normal(0, 0.5, 4), np.array([0.1]), 0.5)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        x = Q.shape(r.text.encode())
        z = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
        h = [max(0.0, sum(z[i] * model.w1[i][j] for i in range(Q.SIZE)) + model.b1[j]) for j in range(4)]
        want[r.doc_id] = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(h, model.w2)) + model.b2[0])))
    assert {r.gm_id: r.score for r in Q.score(docs, model).collect()} == pytest.approx(want)


@pytest.mark.parametrize("total", [1, 12_000, 7_000_000_000, 12_582_912_000, 10**11, 10**15])
def test_samples_never_run_empty(total):
    share = threshold(total, 12_000) / (1 << 63)
    assert share * total >= 2 * 12_000 * 0.999 or share > 0.999


def test_samples_are_bounded(spark):
    """One id for all rows, null ids, many equal rows, and columns named as those that fit() makes."""
    rows = [(7, f"text number {i} of the id", 1) for i in range(300)] + [(None, "the same words again", 1)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, gm_good int").selectExpr("*", "1 as gm_unl", "2 as gm_pick", "3 as gm_id", "4 as gm_key", "5 as gm_text", "6 as score")
    seen = []
    known, Q.fit_network = Q.fit_network, lambda pos, unl, *a, **k: seen.append((len(pos), len(unl))) or known(pos, unl, *a, **k)
    try:
        assert Q.fit(df, spark.createDataFrame([(7,)], "doc_id long"), max_positive=20, max_unlabelled=40) is not None
    finally:
        Q.fit_network = known
    assert seen[-1] == (20, 40)


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "ok words here"), (3, "ok words here"), (4, "w " * 500_000), (5, " \n\t ")]
    df = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long")
    assert Q.fit(df, none) is None and Q.fit(df.limit(0), none) is None
    assert {r.score for r in Q.score(df, None).collect()} == {0.5}
    model = Q.fit(df, spark.createDataFrame([(3,), (3,), (None,)], "doc_id long"))
    got = Q.score(df, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and Q.score(df.limit(0), model).count() == 0


# ---------------------------------------------------------------- the tokenizer


@pytest.fixture(scope="module")
def pair():
    with open(P.MODEL, "rb") as file:
        raw = file.read()
    return P.Transducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw), raw


def texts(n, seed):
    rng = random.Random(seed)
    bits = ["a", "b", "the", "The", " ", "  ", "\n", "é", "ß", "日本", "語", "🎉", "th", "ing", "tion", "▁", ".", "0", "17", "\t", "zzz", "     ", "###", "́", "\x00"]
    return ["", " ", "▁", "  a", "a  ", "x" * 3000, "日" * 500, " " * 70, " " * 33 + "the" + " " * 18 + "x"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_bpe_equals_the_library(pair):
    machine, library, _ = pair
    for text in texts(3000, 1):
        assert machine.encode(text) == library.encode(text), repr(text)


def test_decoding(pair):
    machine, library, _ = pair
    for text in texts(1500, 2):
        assert machine.decode(machine.encode(text)) == text.replace("▁", " ")
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert machine.decode(ids) == library.decode(ids)


def test_unigram_paths_are_shortest(pair):
    """The same pieces read as a unigram model: no segmentation of a short text weighs less."""
    raw = pair[2]
    at = raw.index(b"\x18\x02", raw.index(b"tok_v0"))
    machine = P.Transducer(raw[: at + 1] + b"\x01" + raw[at + 2 :])

    def weight(piece):
        return -machine.score[piece] if piece in machine.score else float(machine.unknown_weight) if len(piece) == 1 else float("inf")

    for text in texts(300, 4):
        text = "▁" + text.replace(" ", "▁")[:11]
        least = min(sum(weight(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])) for n in range(len(text)) for cuts in itertools.combinations(range(1, len(text)), n))
        found = machine.path(text)
        assert "".join(found) == text and sum(map(weight, found)) == pytest.approx(least)


def message(number, value):
    """A field of a protocol buffer message."""
    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)
    return size(number << 3 | 2) + size(len(value)) + value if isinstance(value, bytes) else size(number << 3) + size(value)


def remade(raw, kind, normal, fallback=True):
    """The model's pieces (without its bytes unless ``fallback``) with a model type and the fields of a normaliser.

    In a unigram model, scores of -1e9 become -40000 and less: sums of larger ones are all ties in 32 bits.
    """
    out = b""
    for place, (number, value) in enumerate(P._fields(raw)):
        entry = dict(P._fields(value)) if number == 1 else {}
        if number != 1 or not fallback and entry.get(3) == P._BYTE:
            continue
        if kind == P.UNIGRAM and 2 in entry and struct.unpack("<f", entry[2])[0] < -1e8:
            value = value.replace(entry[2], struct.pack("<f", -40000 - place))
        out += message(1, value)
    return out + message(2, message(3, kind) + message(35, int(fallback))) + message(3, b"".join(message(n, v) for n, v in normal.items()))


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("kind", [P.UNIGRAM, P.BPE])
@pytest.mark.parametrize("dummy,reduce", [(1, 1), (1, 0), (0, 1), (0, 0)])
def test_normalised_models_equal_the_library(pair, rule, kind, dummy, reduce):
    """Character maps, dummy spaces and reduced spaces, with and without byte fallback."""
    known = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    blob = next((dict(P._fields(v)).get(2, b"") for n, v in P._fields(known.serialized_model_proto()) if n == 3), b"")
    assert bool(blob) == (rule != "identity")
    normal = {1: rule.encode(), **({2: blob} if blob else {}), 3: dummy, 4: reduce, 5: 1}
    odd = ["ﬁne ﬂow", "Ａ Ｂ　Ｃ", "e\u0301te\u0301", "a\tb\nc", "\u00a0x\u00a0", "½ ㍿ ①", "ß ſ İ", "¨ x", " \t ", "한국어 \u1100\u1161", "a \u0301b", "\u200bx\u200b y", "　", "a\u2581b \u2581", "x  ￼ "]
    for fallback in (True, False):
        raw = remade(pair[2], kind, normal, fallback)
        machine, library = P.Transducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
        for text in odd + texts(50, 6):
            if text.strip("▁") == text or rule == "identity" and not reduce:
                assert machine.encode(text) == library.encode(text), repr(text)


def test_paths_by_brute_force(pair):
    """Every way to read a short text along arcs of the composed machines: the path is the one of least weight, and in a BPE model the one that is finite."""
    machine, library = pair[0], pair[1]
    for text in texts(400, 9):
        norm = machine.normaliser.run(text)[:10]
        found = []
        todo = [(0, 0.0, [])]
        while todo:
            at, weight, read = todo.pop()
            if at == len(norm):
                found.append((weight, read))
                continue
            for piece in {norm[at], *(norm[at:j] for j in range(at + 1, len(norm) + 1) if norm[at:j] in machine.ids)}:
                ends = not read or machine.compatible(read[-1], piece)
                if ends and (len(piece) == 1 or machine.last_merge(piece)):
                    todo.append((at + len(piece), weight + machine.weight(piece), [*read, piece]))
        assert [r for _, r in found] == [machine.path(norm)] if norm else found == [(0.0, [])]


def test_seams_equal_merging(pair):
    """Two pieces are compatible exactly if merging their characters, leftmost of the best first, ends in the two."""
    machine = pair[0]

    def merged(text):
        parts = list(text)
        while True:
            ranks = [(machine.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not ranks or min(ranks)[0] == 1 << 60:
                return parts
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(10)
    whole = [p for p in machine.ids if len(p) == 1 or machine.last_merge(p)]
    runs = ["▁" * n for n in range(1, 17)]
    for _ in range(6000):
        a, b = (rng.choice(runs if rng.random() < 0.3 else whole) for _ in range(2))
        if a in machine.ids and b in machine.ids:
            assert machine.compatible(a, b) == (merged(a + b) == [a, b]), (a, b)


def test_small_memory_changes_nothing(pair):
    machine = P.Transducer(pair[2], remembered=5)
    assert [machine.encode(t) for t in texts(300, 5)] == [pair[0].encode(t) for t in texts(300, 5)]


def test_documents_equal_the_library(spark, pair):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in P.op6_pieces(spark, "/root/testdata/sf0.001").collect():
        assert r.ids == pair[1].encode(docs[r.doc_id]) and r.n_tokens == len(r.ids) and r.exact


def test_tokens_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "▁", 0), (4, "w " * 300_000, 0)], "doc_id long, text string, ids int")
    coded = P.encode(df)
    back = {r.gm_id: r.text for r in P.decode(coded.select(F.col("gm_id").alias("doc_id"), "ids")).collect()}
    assert back == {1: "", 2: "", None: "a b", 3: " ", 4: "w " * 300_000} and not coded.filter("gm_id = 3").first().exact
    assert P.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.Transducer(remade(b"", P.UNIGRAM, {5: 0}))
