"""Benchmark decontamination by size-partitioned MinHash containment search.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters in the
lower-cased text; a shingle is ``width`` consecutive words, and a text of fewer words has
one shingle, all of them.  An item is found in a document if the document contains at
least ``threshold`` of the item's distinct shingles, wherever they stand.  So an item of fewer words
than ``width`` is found only in texts that are the same words: a word or two that many
documents hold are no leak.

Search.  Documents are partitioned by size: class c holds those with 2^(c-1) < n <= 2^c
shingles.  A document's sketch is a one-permutation MinHash with 2^(c+2) bins, so a bin
holds a quarter of a shingle on average in every class, however long the document is;
items are sketched once for each class, with as many bins, and every bin is a band of one
row.  A contained shingle is the minimum of its bin with probability of at least 7/8, so
an item with q contained shingles is missed with probability of about 8^-q.  Items
too small for 1e-9 get as many independent permutations as they need.

Verification.  Candidates are compared shingle by shingle, as strings.

Scale.  Documents are not shuffled: the distinct texts of items go to them, in blocks of at most about
``block_bytes``, one pass over the documents a block; what is found there is joined with the items' ids.  Matching happens where a
document is read, so a group of copies or a hot source is no heavier than other rows, and an item that is
repeated under many ids is searched once.  All blocks together are the benchmark, which this operator takes to be small beside the documents:
with a benchmark of B bytes the documents are read B / ``block_bytes`` times.

Defined cases.  Null and empty texts, and those without words, have no shingles: nothing is found in such
documents and such items are found nowhere.  Ids may be of any type; null ids stay null.  Repeated documents or items give repeated
results.  Very long texts are cut into segments for hashing only and matched as a whole.  Empty tables give empty results.  Other columns are
ignored by ``leaks`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import documents, id_and_text, runs, small_batches

_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_RANDOM = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEGMENT = 1 << 20
_MISS = 1e-9
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for the places in a segment."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(_SEGMENT + 1, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lowered(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of the lower-cased texts, the empty string for null."""
    return [v.as_py() or b"" for v in pc.utf8_lower(column).cast(pa.binary())]


def shingles(text: bytes, width: int) -> set[str]:
    """Distinct shingles of a lower-cased text."""
    found = _WORD.findall(text.decode("utf-8", "replace"))
    return {" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a lower-cased text.

    Prefix sums of byte codes times powers of an odd base give the hash of any word as a difference of two of
    them; they are taken over one segment of words at a time.  A word longer than a segment is hashed whole.
    """
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SEPARATOR[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[::2], edge[1::2]
    hashes = np.zeros(len(begin), dtype=np.uint64)
    up, down = _power_tables()
    at = 0
    while at < len(begin):
        base = begin[at]
        to = int(np.searchsorted(end, base + _SEGMENT, "right"))
        if to == at:
            hashes[at] = xxhash.xxh64_intdigest(data[base : end[at]].tobytes())
            at += 1
            continue
        part, b, e = data[base : end[to - 1]], begin[at:to] - base, end[at:to] - base
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_RANDOM[part] * up[: len(part)], out=total[1:])
        hashes[at:to] = mix((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64))
        at = to
    return hashes, begin


def shingle_hashes(found: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle of lower-cased texts, by text."""
    data = np.frombuffer(b"\n".join(found), dtype=np.uint8)
    hashes, starts = word_hashes(data)
    edges = np.cumsum([len(t) + 1 for t in found])
    owner = np.searchsorted(edges, starts, side="right")
    if not len(hashes):
        return hashes, owner
    n = max(0, len(hashes) - width + 1)
    full = owner[:n] == owner[width - 1 :] if n else np.zeros(0, bool)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * _STEPS[j]
    out, whose = mix(total[full], width), owner[:n][full]
    count = np.bincount(owner, minlength=len(found))
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        first = np.cumsum(count) - count
        for t in few:
            part = hashes[first[t] : first[t] + count[t]] * _STEPS[: count[t]]
            out = np.append(out, mix(np.array([part.sum(dtype=np.uint64)]), int(count[t])))
            whose = np.append(whose, t)
        order = np.argsort(whose, kind="stable")
        out, whose = out[order], whose[order]
    return out, whose


def minima(hashes: np.ndarray, owner: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Indexes of the minimum of each bin of each owner; bins: the power of two of bins, for each hash."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    cell = h >> (np.uint64(64) - bins[order].astype(np.uint64))
    first = np.ones(len(h), dtype=bool)
    first[1:] = (o[1:] != o[:-1]) | (cell[1:] != cell[:-1])
    return order[first]


def _class(count: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)


class Index:
    """Items sketched for every size class, and their shingles for verification."""

    def __init__(self, items: list[str], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        texts = lowered(pa.array(items, pa.string()))
        live = [(key, text, s) for key, text in zip(items, texts) if (s := shingles(text, width))]
        self.items = [(key, s) for key, _, s in live]
        need = [max(1, math.ceil(math.log(_MISS, 1 / 8) / math.ceil(threshold * len(s)))) for _, s in self.items]
        self.permutations = max(need, default=0)
        hashes, owner = shingle_hashes([text for _, text, _ in live], width)
        self.sketches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.raw = (hashes, owner, np.array(need))
        self.sieve = np.zeros(1 << 20, dtype=bool)
        for p in range(self.permutations):
            self.sieve[mix(hashes, p) & np.uint64((1 << 20) - 1)] = True

    def sketch(self, size: int, permutation: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted minima of the items for a size class, and the item of each."""
        key = size << 8 | permutation
        if key not in self.sketches:
            hashes, owner, need = self.raw
            use = need[owner] > permutation
            h, o = mix(hashes[use], permutation), owner[use]
            at = minima(h, o, np.full(len(h), size + 2))
            order = at[np.argsort(h[at], kind="stable")]
            self.sketches[key] = h[order], o[order]
        return self.sketches[key]

    def candidates(self, found: list[bytes]) -> set[tuple[int, int]]:
        """(text number, item number) that share the minimum of a bin."""
        hashes, owner = shingle_hashes(found, self.width)
        pairs: set[tuple[int, int]] = set()
        if not len(hashes):
            return pairs
        size = _class(np.bincount(owner, minlength=len(found)))[owner]
        for p in range(self.permutations):
            h = mix(hashes, p)
            at = minima(h, owner, size + 2)
            at = at[self.sieve[h[at] & np.uint64((1 << 20) - 1)]]
            for c in np.unique(size[at]):
                here = at[size[at] == c]
                keys, item = self.sketch(int(c), p)
                low, high = np.searchsorted(keys, h[here], "left"), np.searchsorted(keys, h[here], "right")
                for x, a, b in zip(here[high > low], low[high > low], high[high > low]):
                    pairs.update((int(owner[x]), int(i)) for i in item[a:b])
        return pairs

    def match(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item number, shared shingles) of every contained item, verified."""
        found = lowered(column)
        out = []
        for a, b in runs([len(t) for t in found]):
            seen, held = -1, set()
            for row, item in sorted(self.candidates(found[a:b])):
                if row != seen:
                    seen, held = row, shingles(found[a + row], self.width)
                shared = len(self.items[item][1] & held)
                if shared >= self.threshold * len(self.items[item][1]):
                    out.append((a + row, item, shared))
        return out


_last: list = []


def _index(block: list[str], width: int, threshold: float) -> Index:
    """The index of a block, compiled once for the tasks that a worker runs one after another."""
    if not _last or _last[0] is not block or _last[1:3] != [width, threshold]:
        _last[:] = [block, width, threshold, Index(block, width, threshold)]
    return _last[3]


def _blocks(items: DataFrame, text_col: str, block_bytes: int) -> Iterator[list[str]]:
    """The distinct texts of the items in blocks of at most about ``block_bytes``, one after another."""
    rows = items.select(F.col(f"`{text_col}`").cast("string").alias("gm_text")).filter("gm_text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("gm_text"))).first()[0] or 0
    parts = int(total // block_bytes) + 1
    for b in range(parts):
        yield sorted(r[0] for r in rows.filter(F.pmod(F.xxhash64("gm_text"), F.lit(parts)) == b).collect())


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per document and item that it contains: the ids, ``shared`` and ``item_shingles``."""
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["gm_id"].dataType.simpleString()
    out = None
    for block in _blocks(items, item_text, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(held.value, width, threshold)
            for batch in batches:
                hits = index.match(batch.column(1))
                found = [index.items[h[1]] for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([hashlib.sha256(text.encode()).hexdigest() for text, _ in found], pa.string()),
                     pa.array([h[2] for h in hits], pa.int64()), pa.array([len(held) for _, held in found], pa.int64())],
                    names=["gm_id", "gm_sha", "shared", "item_shingles"],
                )

        part = rows.mapInArrow(work, f"gm_id {kind}, gm_sha string, shared long, item_shingles long")
        out = part if out is None else out.union(part)
    named = items.select(F.col(f"`{item_col}`").alias("gm_item"), F.sha2(F.col(f"`{item_text}`").cast("string"), 256).alias("gm_sha"))
    return out.join(named, "gm_sha").select(F.col("gm_id").alias(id_col), F.col("gm_item").alias(item_col), "shared", "item_shingles")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", width: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    out = docs
    for block in _blocks(items, item_text, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(held.value, width, threshold)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[h[0] for h in index.match(batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(work, out.schema)
    return out


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item that any document contains to four fifths or more of its 5-word shingles."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(item_shingles)
"""
