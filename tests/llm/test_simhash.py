"""SimHash groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gistmill.llm import simhash as H

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, H.simhash_groups(df, **options).collect()), key=str)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover(radius):
    """Every pair within the radius agrees under some mask; no mask is empty."""
    masks = [m & 0xFFFFFFFFFFFFFFFF for m in H.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1 and all(m.bit_count() >= 20 for m in masks)
    rng = random.Random(radius)
    for _ in range(4000):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("radius", [2, 4])
def test_finer_masks_cover(radius):
    """Pairs within the radius that a mask keeps together agree under a finer mask of the bits that it leaves free."""
    rng = random.Random(radius)
    for mask in H.covering_masks(radius):
        free = [b for b in range(64) if not mask >> b & 1]
        finer = [m & 0xFFFFFFFFFFFFFFFF for m in H.covering_masks(radius, ~mask)]
        assert not any(m & mask for m in finer)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(free, radius))
            assert any(not flips & m for m in finer)


def test_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_chains_and_copies(spark):
    """Texts that drift word by word, exact copies of a third, in cells cut into blocks of a few nodes."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, text = [], [rng.choice(words) for _ in range(300)]
    for i in range(120):
        text = list(text)
        text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, rows[5][1]) for i in range(60)]
    assert run(spark, rows, block=4) == run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, "One"), (8, "oNE"), (None, "x y z w v"), (None, ""), (4, "É é a b"), (4, "É é a b"), (6, "word " * 30_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, gm_fp string, component_id long")
    assert H.simhash_groups(df).columns == ["doc_id", "fingerprint", "component_id"]


def test_near_copies(spark):
    """Copies of a similarity of 0.8 or more fall together, other texts stay apart, one of each group is kept."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(120, 400))]
        for c in range(4):
            copy = list(base)
            for _ in range(c * len(base) // 200):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
            group[len(rows) - 1] = g * 4
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = {r.gm_id: r.component_id for r in H.near_groups(df).collect()}
    assert all(c == d or group[d] == group[c] for d, c in got.items())  # nothing else is linked
    assert sum(got[d] == group[d] for d in got) >= 0.97 * len(got)  # the candidate search is probabilistic
    kept = H.deduplicated(df.union(df.filter("doc_id = 0")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == df.columns


def test_dedup_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in H.deduplicated(df).collect()) == [(2, "a b c d e f"), (3, None)]
    assert H.deduplicated(df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, f"document {i} with words of its own like w{i} x{i} y{i}") for i in range(9)] * 2 + [(None, ""), (None, None)], "doc_id long, text string")
    assert H.deduplicated(nameless).count() == 10


def test_names_of_columns_and_rows_that_differ_elsewhere(spark):
    """Columns named as those made inside stay as they are; of rows of one id and text the least hash of the row stays, whatever the order."""
    text = "a b c d e f g h"
    names = ["gm_id", "gm_text", "gm_r1", "gm_row", "gm_node", "component_id"]
    rows = [(1, text, *[f"v{i}{n}" for n in names], {"k": i}) for i in range(6)] + [(2, "other words stand in this one", *names, {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names) + ", m map<string,int>")
    one, two = (sorted(map(str, H.deduplicated(d).collect())) for d in (df, df.orderBy(F.desc("gm_id")).repartition(3)))
    assert one == two and len(one) == 2 and H.deduplicated(df).columns == df.columns


def test_links_of_large_cells_are_few(spark):
    """A hot group of near copies, most of them in one cell, and texts near it that are no copies: as by brute force, and edges in proportion to nodes."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(146)]
    rows = []
    for i in range(240):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    want, pairs = exact_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (16, 512):
        assert {r.gm_id: r.component_id for r in H.near_groups(df, block=block).collect()} == want
    assert pairs > 2000
    # edges out of one task: at most one for each row but the first
    near = lambda at, others: others % 3 == at % 3
    assert len(H.forest(90, near)) == 87
    label = np.arange(90) % 2
    assert sorted(H.bridges(np.arange(45), np.arange(45, 90), label, near))[0][0] == 0 and len(H.bridges(np.arange(45), np.arange(45, 90), label, near)) == 1


def test_many_texts_about_one_passage(spark, monkeypatch):
    """A frequent passage puts texts that are no copies, and a few pairs of copies among them, into cells of many blocks: as by brute force."""
    monkeypatch.setattr(H, "APART", 2)
    rng = random.Random(14)
    words = [f"word{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(rng.randint(20, 60))] + passage)) for i in range(200)]
    rows += [(1000 + i, " ".join(edited(rng, words, rows[5 * i][1].split(), "scattered", 0.1))) for i in range(30)]
    want, pairs = exact_groups(rows)
    seen = []
    known, H._linked = H._linked, lambda *a, **k: seen.append(1) or known(*a, **k)
    try:
        got = {r.gm_id: r.component_id for r in H.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    finally:
        H._linked = known
    assert got == want and pairs >= 30 and len(seen) == 2


def test_sifting_loses_no_row(spark, monkeypatch):
    """Every wanted row passes the bitmap, also one that is full; few others pass one that is not."""
    rows = spark.range(3000).select(F.xxhash64("id").alias("gm_r1"), "id")
    wanted = rows.filter("id % 10 = 0").select("gm_r1")
    for words, most in ((1 << 20, 310), (8, 3000)):
        monkeypatch.setattr(H, "_WORDS", words)
        got = [r.id for r in H._sifted(rows, wanted).collect()]
        assert set(range(0, 3000, 10)) <= set(got) and len(got) == len(set(got)) <= most
        assert H._sifted(rows, wanted.limit(0)).count() == 0


def shingle_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact_groups(rows):
    """Components of all pairs of a Jaccard similarity of 0.8 or more, and how many such pairs there are."""
    sets, root, pairs = [shingle_sets(t) for _, t in rows], list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}, pairs


def edited(rng, words, base, kind, part):
    """A copy of ``base`` with a passage of ``part`` of its words appended, wrapped around it or cut off, or as many words changed one by one."""
    n = round(part * len(base))
    fresh = [rng.choice(words) for _ in range(n)]
    if kind == "appended":
        return base + fresh
    if kind == "wrapped":
        return fresh[: n // 2] + base + fresh[n // 2 :]
    if kind == "cut":
        return base[: len(base) - n]
    copy = list(base)
    for at in rng.sample(range(len(base)), n // 5):
        copy[at] = rng.choice(words)
    return copy


@pytest.mark.parametrize("kind", ["appended", "wrapped", "cut", "scattered"])
def test_every_kind_of_copy_is_found(spark, kind):
    """Copies near the bound on both sides, repeated shingles among them: the groups are those of brute force."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 600))]
        if g % 3 == 0:
            base += base[:20] * 5
        rows += [(4 * g + c, " ".join(edited(rng, words, base, kind, part))) for c, part in enumerate((0, 0.1, 0.19, 0.24))]
    want, pairs = exact_groups(rows)
    assert pairs > 60
    got = {r.gm_id: r.component_id for r in H.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    assert got == want


def test_no_link_below_the_bound(spark):
    """Texts of similarities from 0.55 to 0.8 stay apart, and an edge that fails leaves the others: documents of the table as by brute force."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(i, " ".join(edited(rng, words, base, "scattered", 0.12 + 0.01 * (i % 10)))) for i in range(60)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = exact_groups(rows)
    assert len({want[i] for i in range(60)}) > 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.gm_id: r.component_id for r in H.near_groups(df, block=16).collect()} == want
    assert sorted(r.doc_id for r in H.deduplicated(df).collect()) == sorted(set(want.values()))


def test_near_copies_come_through_covering_masks(spark):
    """With the MinHashes shut out, the copies within 4 bits are still found, all of them, by the masks of the fingerprints, and only those of 0.8 or more."""
    rng = random.Random(21)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(100, 500))]
        rows += [(4 * g + c, " ".join(edited(rng, words, base, kind, part))) for c, (kind, part) in enumerate((("cut", 0), ("appended", 0.01), ("cut", 0.03), ("scattered", 0.06)))]
    sets = [H.shingle_set(t.encode()) for _, t in rows]
    prints = [H.set_fingerprint(s) for s in sets]
    assert prints[5] == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in sets[5]) > len(sets[5]))
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4 and H.similar(sets[i], sets[j])]
    want = {i: i for i, _ in rows}
    for _ in rows:
        for i, j in edges:
            want[i] = want[j] = min(want[i], want[j])
    assert len(edges) > 60
    got = H.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=8, least=H.BANDS * H.ROWS + 1)
    assert {r.gm_id: r.component_id for r in got.collect()} == want
