"""TIFF round trips, hand-made files, WARC archives and their index."""

import gzip
import hashlib
import json
import math
import os
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gistmill.llm import tiff as T
from gistmill.llm import warc as W

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("codec", [T.NONE, T.LZW, T.DEFLATE, T.OLD_DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 48)])
@pytest.mark.parametrize("fill", [1, 2])
def test_round_trip(codec, order, predictor, tile, fill):
    rng = random.Random(5)
    for payload in (bytes(64), rng.randbytes(64 * 70), b"abcabc " * 640, bytes(64 * 300) + b"\xff" * 640):
        payload += bytes(-len(payload) % 64)
        data = T.write(payload, codec=codec, predictor=predictor, order=order, tile=tile, page_bytes=64 * 90, strip_bytes=1000, fill=fill)
        found = list(T.read(data))
        assert [f["error"] for f in found] == [None] * len(found) and b"".join(f["samples"] for f in found) == payload
        assert len(found) == -(-len(payload) // (64 * 90)) and {f["compression"] for f in found} == {codec}
        assert [f["last"] for f in found] == [False] * (len(found) - 1) + [True] and found[-1]["so_far_sha256"] == hashlib.sha256(payload).hexdigest()
        for i, f in enumerate(found):
            so_far = b"".join(g["samples"] for g in found[: i + 1])
            assert (f["so_far_bytes"], f["so_far_tail"], f["so_far_feature"]) == (len(so_far), so_far[-64:], plain_features(so_far)) and f["feature"] == plain_features(f["samples"])


def plain_features(data: bytes) -> str:
    n = len(data)
    mean = sum(data) / n
    counts = [data.count(bytes((v,))) for v in range(256)]
    share = [c / n for c in counts]
    sd = sum(p * (v - mean) ** 2 for v, p in enumerate(share)) ** 0.5
    entropy = -sum(p * math.log2(p) for p in share if p)
    return f"mean={mean:.3f};sd={sd:.3f};entropy={abs(entropy):.4f};bands=" + "/".join(f"{sum(counts[32 * i : 32 * i + 32]) / n:.4f}" for i in range(8))


def test_pages_over_the_bound_are_not_decoded():
    """A small file that says it is huge, and one that is, are errors of that page; digests end there."""
    big = T.write(bytes(64 * 4000) + b"x" * 64 * 4000, page_bytes=64 * 4000)
    found = list(T.read(big, max_page_bytes=64 * 3999))
    assert [f["samples"] for f in found] == [None, None] and all("over" in f["error"] for f in found)
    mixed = T.write(b"a" * 64 * 30, page_bytes=64 * 20)
    found = list(T.read(mixed, max_page_bytes=64 * 10))
    assert [f["error"] is None for f in found] == [False, True] and [f["so_far_sha256"] for f in found] == [None, None] and found[1]["samples"] == b"a" * 640
    huge = tiff([(256, 4, [1 << 20]), (257, 4, [1 << 20]), (258, 3, [8]), (259, 3, [8]), (273, 4, None), (278, 4, [1 << 20]), (279, 4, [20])], [zlib.compress(b"")])
    assert "over" in next(T.read(huge))["error"]


def test_every_form_is_met():
    forms = [T.layout(64 * n) for n in range(1, 40)]
    assert {f.get("codec", T.DEFLATE) for f in forms} == {T.NONE, T.LZW, T.DEFLATE, T.PACKBITS}
    assert {f.get("predictor", 2) for f in forms} == {1, 2} and {"tile" in f for f in forms} == {True, False}
    rng = random.Random(1)
    for n in [1, 2, 3, 4, 31, 32, 33, 1024, 1025, 5000]:
        payload = bytes(rng.choice(b"abc ") for _ in range(64 * n))
        found = list(T.read(T.write(payload, **T.layout(len(payload)))))
        assert b"".join(f["samples"] for f in found) == payload and len(found) == max(1, -(-len(payload) // 65536))


@given(st.binary(max_size=3000), st.integers(1, 9))
def test_codecs(data, repeat):
    data = data * repeat
    assert T.unlzw(T.lzw(data), len(data)) == data and T.unpack_bits(T.pack_bits(data), len(data)) == data


def tiff(tags: list[tuple], strips: list[bytes], order="<") -> bytes:
    """A one-page file with the given tags; tag 273 or 324 gets the strips' places."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + sum(map(len, strips))))
    places = []
    for s in strips:
        places.append(len(out))
        out += s
    entries, extra = b"", len(out) + 2 + 12 * len(tags) + 4
    late = b""
    for tag, kind, values in sorted(tags):
        values = places if values is None else values
        body = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(body) > 4:
            late, body = late + body, struct.pack(order + "I", extra + len(late))
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return bytes(out) + struct.pack(order + "H", len(tags)) + entries + bytes(4) + late


@pytest.mark.parametrize("order", ["<", ">"])
def test_wide_samples_planes_and_float_predictor(order):
    image = (np.arange(3 * 5 * 2).reshape(3, 5, 2) * 1000).astype(f"{order}u2")
    size = [(256, 4, [5]), (257, 4, [3]), (258, 3, [16, 16]), (259, 3, [1]), (277, 3, [2]), (278, 4, [3])]
    flat = image.astype(image.dtype.newbyteorder("<")).tobytes()
    for predictor in (1, 2):
        stored = image if predictor == 1 else np.diff(image.astype("u2"), axis=1, prepend=np.zeros((3, 1, 2), "u2")).astype(f"{order}u2")
        got, = T.read(tiff([*size, (273, 4, None), (279, 4, [60]), (317, 3, [predictor])], [stored.tobytes()], order))
        assert got["error"] is None and got["samples"] == flat
        planes = [np.ascontiguousarray(stored[:, :, p]).tobytes() for p in (0, 1)]
        got, = T.read(tiff([*size, (273, 4, None), (279, 4, [30, 30]), (284, 3, [2]), (317, 3, [predictor])], planes, order))
        assert got["error"] is None and got["samples"] == flat
    real = np.linspace(-3, 7, 12, dtype="<f4").reshape(3, 4)
    rows = real.astype(">f4").view(np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    coded = np.diff(rows, axis=1, prepend=np.zeros((3, 1), np.uint8))
    got, = T.read(tiff([(256, 4, [4]), (257, 4, [3]), (258, 3, [32]), (259, 3, [8]), (273, 4, None), (278, 4, [3]), (279, 4, [len(zlib.compress(coded.tobytes()))]), (317, 3, [3]), (339, 3, [3])], [zlib.compress(coded.tobytes())], order))
    assert got["error"] is None and np.frombuffer(got["samples"], "<f4").tolist() == real.ravel().tolist()


def test_broken_files():
    good = T.write(bytes(range(64)) * 4, codec=T.LZW)
    for bad in (b"", b"II", b"PK\x03\x04aaaa", good[:20], good[:-30], tiff([(256, 4, [5])], []), tiff([(256, 4, [9]), (257, 4, [9]), (258, 3, [8]), (259, 3, [7]), (273, 4, None)], [b"x"])):
        found = list(T.read(bad))
        assert len(found) <= 1 and all(f["error"] and f["samples"] is None for f in found)
    looped = bytearray(T.write(bytes(64)))
    looped[-4:] = looped[4:8]
    assert len(list(T.read(bytes(looped)))) == 1


def test_pages_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "é"), (3, "x" * 64), (3, "x" * 64), (4, "long " * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    made = T.media(df, page_bytes=1 << 20)
    for bound in (8 << 20, 1):
        got = sorted(T.pages(made, batch_bytes=bound).collect(), key=lambda r: (str(r.of.gm_id), r.page))
        assert [(r.of.gm_id, r.page, len(r.samples), r.last) for r in got] == [
            (1, 0, 64, True), (2, 0, 64, True), (3, 0, 64, True), (3, 0, 64, True), (4, 0, 1 << 20, False), (4, 1, 2_000_000 - (1 << 20), True), (None, 0, 64, True),
        ]
    assert got[2].feature == got[3].feature and got[2].media_sha256 == got[3].media_sha256
    named = made.selectExpr("gm_id as page", "n_bytes as samples", "media", "1 as of", "'x' as last")
    assert T.pages(named).filter("of.page = 4 and last").select("of.last", "of.samples", "so_far_bytes").first() == ("x", 2_000_000, 2_000_000)
    assert T.pages(made.select("media")).count() == 7
    assert T.pages(made.limit(0)).count() == 0
    assert T.pages(spark.createDataFrame([(1, None), (2, b"junk")], "id int, media binary")).filter("error is not null").count() == 1


def test_documents_through_tiff(spark):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in T.op4_tiff(spark, SF).collect():
        payload = docs[r.doc_id] + bytes(-len(docs[r.doc_id]) % 64 if docs[r.doc_id] else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file = T.write(payload, **T.layout(len(payload)))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(file), hashlib.sha256(file).hexdigest(), plain_features(payload))


# ---------------------------------------------------------------- WARC


def test_keys():
    assert [W.reversed_host(u) for u in ("http://www.Example.COM/a?b=1#c", "https://a.b.org:443", "http://a.b.org:8080/x", "http://[bad", None, "", "no url", "http://u@h.net/%7e")] == [
        "com,example)/a?b=1", "org,b,a)/", "org,b,a:8080)/x", "http://[bad", "", "", "no url", "net,h)/%7e",
    ]


def pages(spark):
    same, hot = "s" * 100, "h" * 300
    rows = [(7, "http://a.com/1", same), (3, "http://a.com/2", same), (9, None, same), (1, "http://b.com/\r\nX: y", None), (2, "", ""), (4, "http://b.com/", "z" * 99), (5, "http://b.com/", "z" * 99), (6, "http://c.com/é", "é" * 60)]
    rows += [(100 + i, "http://hot.com/", hot) for i in range(60)] + [(8, "u", "rep" * 50)] * 2 + [(None, "n", "nul" * 50), (50, "n", "nul" * 50)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def archive(spark, df, tmp_path, block_lines=5, **options):
    a = f"file://{tmp_path}/archive"
    captures, _ = W.write_archives(df, a)
    return captures, W.write_index(captures, f"file://{tmp_path}/index", block_lines, **options), a


def every(df, index, a, **options):
    return W.fetch(W.search(W.keys_of(df), index), a, **options)


def test_archives(spark, tmp_path):
    df = pages(spark)
    captures, index, a = archive(spark, df, tmp_path)
    assert captures.count() == df.count() and index.directory.count() >= df.count() // 5 and index.levels == 1
    got = W.resolved(every(df, index, a))[0].collect()
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == df.count() and all(r.payload_digest == r.stated_digest for r in got)
    kinds = {k[0]: (r.record_type, r.refers_to) for k, r in by.items()}
    assert (kinds[3], kinds[7], kinds[9], kinds[4], kinds[5], kinds[8]) == (("response", None), ("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None))
    assert kinds[100] == ("response", None) and kinds[101] == kinds[159] == ("revisit", 100) and kinds[None] == ("revisit", 50)
    html = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert all((r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha256(html[r.page_id]).hexdigest()) for r in got)
    assert by[9, None].url is None and (1, "http://b.com/%0D%0AX: y") in by
    kept = every(df, index, a, payloads=True).filter("record_type = 'response'").collect()
    assert {r.page_id: bytes(r.payload) for r in kept} == {r.page_id: html[r.page_id] for r in got if r.record_type == "response"}


def test_files_are_plain_warc(spark, tmp_path):
    archive(spark, pages(spark), tmp_path)
    records = 0
    for name in os.listdir(tmp_path / "archive"):
        text = gzip.decompress((tmp_path / "archive" / name).read_bytes())
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            size = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest[size : size + 4] == b"\r\n\r\n"
            text, records = rest[size + 4 :], records + 1
    assert records == pages(spark).count()


@pytest.mark.parametrize("top_rows", [1 << 16, 4, 2])
def test_lookup(spark, tmp_path, top_rows):
    """A directory of one level, and of as many as it takes to be bounded."""
    df = pages(spark)
    _, index, a = archive(spark, df, tmp_path, block_lines=3, top_rows=top_rows)
    assert index.directory.count() <= top_rows and (index.levels > 1) == (top_rows < 10)
    asked = spark.createDataFrame([("http://HOT.com/",), ("http://a.com/2#x",), ("http://none.com/",), (None,), ("http://b.com/",), ("http://b.com:80/",), ("zzz",), ("http://b.com/",)], "url string")
    got = W.lookup(asked, index, a).groupBy("asked_url").count().collect()
    assert {r.asked_url: r["count"] for r in got} == {"http://HOT.com/": 60, "http://a.com/2#x": 1, "http://b.com/": 2, "http://b.com:80/": 2, None: 2}
    assert every(df, index, a).count() == df.count()


def test_blocks_by_brute_force():
    """Binary search in a block against a look at every line, keys repeated and absent."""
    rng = random.Random(7)
    for _ in range(300):
        keys = sorted(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(1, 12)))
        lines = [f'{json.dumps(k)} {W.STAMP} {json.dumps([k, n])}' for n, k in enumerate(keys)]
        for key in ("", "a", "aa", "c", "dd", "h"):
            assert sorted(e[1] for e in W.entries(lines, key)) == [n for n, k in enumerate(keys) if k == key]


def test_pages_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, W.op5_warc(spark, SF).collect())) == sorted(con.sql(W.OP5_SQL).fetchall())


def test_no_pages(spark, tmp_path):
    df = pages(spark).limit(0)
    _, index, a = archive(spark, df, tmp_path)
    assert W.resolved(every(df, index, a))[0].count() == W.lookup(df, index, a).count() == 0
