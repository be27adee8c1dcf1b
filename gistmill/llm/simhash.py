"""SimHash near-duplicate groups through covering locality-sensitive hashing.

Fingerprint.  A text is lower-cased (A-Z only) and split into words
``[^\\x20\\x09-\\x0D]+``; its shingles are ``width`` consecutive words joined by one
space, repeats included.  A text of fewer words has one shingle, all its words.
Bit i of the 64-bit fingerprint is set if bit i is set in more than half of the
shingles' XXH64 hashes (seed 42, unsigned).

Covering masks.  Give bit position i a vector f(i) of F2^(r+1), none zero.  For each
nonzero v of F2^(r+1) the mask of table v keeps the positions with <f(i), v> = 1.
Up to r positions span at most r dimensions, so some v is orthogonal to all their
vectors: that table's mask drops every differing bit.  Hence every pair within r
bits meets in one of 2^(r+1)-1 tables: recall is 1 by construction.

Scale.  Equal fingerprints are merged before anything is shuffled by cell, so
thousands of exact copies are one node.  A cell is cut into blocks of bounded rows and bytes, whose nodes are
compared inside one task, which returns a spanning forest of the links it found, never all pairs.  Cells of one block are
done then.  In a larger cell most links are found by now, as blocks differ from cell to cell: its nodes outside the largest component
of the cell are compared with that component's, and with each other, block by block, and only links between
different components are returned.  SimHash cells are cut finer before that, by covering masks of the bits that
the cell's mask leaves free; what shares two masks has at most 2^17 fingerprints.  In a MinHash cell in which the nodes outside are many, as texts are that
share a frequent passage only, these are compared where they share a second band (of the 19 others; a pair of 0.8 shares none with a
probability of 5e-5).  Components are found by
alternating star contraction on stored tables.

``near_groups`` links two texts if the Jaccard similarity of their sets of 5-word shingles is 0.8 or
more.  Texts of one set (by a 128-bit hash) are one node.  Candidates come first from SimHash: the fingerprint of the set, each shingle once, and the
covering masks above, so every pair within 4 bits meets.  A pair of 0.8 differs in about 10 of 64 bits, too many for masks, so the rest come from 80 MinHashes,
one byte each: 20 bands of 4 name further cells.  A pair of one cell is compared as a whole if it lies within 4 bits, or at least 48 of
80 agree, and its sizes allow 0.8.  By calculation a pair of similarity 0.8 is missed with a probability of 3e-5, more similar ones of far less, whatever the
kind of edit, as MinHashes know the similarity alone.  The comparison is of the whole sets, as 48-bit hashes, inside the task that holds the cell's block:
only texts that share a cell with another are read for it.

Defined cases.  A null or empty text, or one of white space, has fingerprint zero
and is linked like any other.  Repeated rows are kept, one result row each.  A row
whose id is null keeps a null id and does not lend it to its component; a component
of such rows only has a null component_id.  Very long texts are read whole; a block holds few of them.  An empty table gives an empty result.
Other columns are ignored by the groups and kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import delete, documents, id_and_text, size_of, small_batches, stored, texts

SEED = 42
#: Bits in which fingerprints that are linked may differ.
RADIUS = 4
#: MinHashes of near_groups: a cell is a band of ROWS; LEAST of all agree in a pair beyond RADIUS that is compared.
BANDS, ROWS, LEAST = 20, 4, 48
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Rows and bytes of a block of nodes.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Blocks of a cell whose nodes are compared with each other without looking for cells that tell them apart.
APART = 8
_BITS = np.array([[(byte >> bit) & 1 for bit in range(8)] for byte in range(256)], dtype=np.int64)


def _spans(words: list[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle of ``width`` words (or all, if fewer) starts and ends in it."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(words) - width + 1)
    return b" ".join(words), (ends - size)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()


def majority(lanes: np.ndarray, counts: np.ndarray) -> None:
    """Add, for each bit of the byte columns ``lanes``, how often it is set to ``counts``."""
    for lane, column in enumerate(lanes.T):
        counts[8 * lane : 8 * lane + 8] += np.bincount(column, minlength=256) @ _BITS


def _bits(counts: np.ndarray, n: int) -> int:
    return sum(1 << bit for bit in range(len(counts)) if 2 * counts[bit] > n)


def fingerprint(text: bytes, width: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined, starts, ends = _spans(words, width)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], dtype="<u8")
        majority(hashes.view(np.uint8).reshape(-1, 8), counts)
    return _bits(counts, len(starts))


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, starts, ends = _spans(words, width)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype="<u8", count=len(starts)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of a set of shingles, each counted once."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        majority(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), counts)
    return _bits(counts, len(hashes))


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """A byte of each of the ``BANDS * ROWS`` MinHashes of a set."""
    least = np.full(len(_FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(least, (_FACTORS[:, None] * high[None, at : at + 1024]).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """gm_id and gm_fp (the fingerprint as a signed long) of every row."""
    small_batches(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t, width)) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["gm_id", "gm_fp"])

    kind = rows.schema["gm_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"gm_id {kind}, gm_fp long")


def covering_masks(radius: int, bits: int = -1) -> list[int]:
    """2^(radius+1)-1 masks of some of the set ``bits`` of 64; any two words within ``radius`` bits agree under one of them."""
    top = (1 << (radius + 1)) - 1
    places = [i for i in range(64) if bits >> i & 1]
    return [_signed(sum(1 << i for n, i in enumerate(places) if (n % top + 1 & v).bit_count() & 1)) for v in range(1, top + 1)]


# ---------------------------------------------------------------- links inside one task

#: Tells which of the rows ``others`` the row ``at`` is linked to.
Near = Callable[[int, np.ndarray], np.ndarray]


def forest(n: int, near: Near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among rows 0 to n - 1."""
    free, edges = np.arange(n), []
    while len(free) > 1:
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            at = queue.pop()
            hit = near(at, free)
            edges += [(at, x) for x in free[hit].tolist()]
            queue += free[hit].tolist()
            free = free[~hit]
    return edges


def bridges(left: np.ndarray, right: np.ndarray, label: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and of ``right`` that join different labels, at most one for each two labels that it joins."""
    label, edges = label.copy(), []
    for at in left.tolist():
        others = right[label[right] != label[at]]
        for x in others[near(at, others)].tolist() if len(others) else []:
            if label[x] != label[at]:
                edges.append((at, x))
                label[label == label[x]] = label[at]
    return edges


def _prints_near(rows: pa.StructArray, radius: int) -> Near:
    node = rows.field("gm_node").to_numpy(zero_copy_only=False).view(np.uint64)
    return lambda at, others: np.bitwise_count(node[others] ^ node[at]) <= radius


def _sets_near(rows: pa.StructArray, radius: int = RADIUS, least: int = LEAST) -> Near:
    """Similarity of 0.8 or more, of sets as sorted 48-bit hashes; only of pairs whose sizes allow it, and whose fingerprints lie within ``radius`` bits or of whose
    MinHashes ``least`` agree."""
    prints = rows.field("gm_fp").to_numpy(zero_copy_only=False).view(np.uint64)
    raw = rows.field("gm_set").to_pylist()
    size = np.array([len(r) // 6 for r in raw])
    marks = np.frombuffer(b"".join(rows.field("gm_marks").to_pylist()), dtype=np.uint8).reshape(len(raw), -1)
    sets: dict[int, np.ndarray] = {}

    def read(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = unpacked(raw[i])
        return sets[i]

    def near(at: int, others: np.ndarray) -> np.ndarray:
        likely = 5 * np.minimum(size[others], size[at]) >= 4 * np.maximum(size[others], size[at])
        some = others[likely]
        likely[likely] = (np.bitwise_count(prints[some] ^ prints[at]) <= radius) | (np.count_nonzero(marks[some] == marks[at], axis=1) >= least)
        likely[likely] = [similar(read(at), read(x)) for x in others[likely].tolist()]
        return likely

    return near


def packed(hashes: np.ndarray) -> bytes:
    """A sorted set of 48-bit hashes, six bytes each."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 5 * common >= 4 * (len(both) - common)


# ---------------------------------------------------------------- links over cells


def _parts(rows: str, size: str, block: int) -> Column:
    """How many blocks rows of so many bytes make."""
    return F.greatest(F.ceil(F.col(rows) / F.lit(block)), F.ceil(F.col(size) / F.lit(float(BLOCK_BYTES)))).cast("int")


def _met(cells: DataFrame, block: int) -> tuple[DataFrame, str]:
    """The rows (gm_node, gm_size, gm_t, gm_cell) of ``cells`` that share a cell, and gm_parts, the blocks of the cell; stored."""
    # crowded cells are stored, so that both sides of the join are plain exchanges, which Spark splits where a cell is hot
    counted = cells.groupBy("gm_cell").agg(F.count("*").alias("gm_n"), F.sum("gm_size").alias("gm_sum"))
    crowded, path = stored(counted.filter("gm_n > 1").select("gm_cell", _parts("gm_n", "gm_sum", block).alias("gm_parts")), "crowded")
    met = stored(cells.join(crowded, "gm_cell"), "met")
    delete(cells.sparkSession, path)
    return met


def _mapped(groups: DataFrame, links_of: Callable) -> DataFrame:
    """Distinct edges (a, b) that ``links_of(rows, n_left)`` finds in the rows gm_left and gm_right of every group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            (left, at), (right, to) = ((c.flatten(), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).tolist()) for c in batch.columns)
            for r in range(batch.num_rows):
                a, b = left[at[r] : at[r + 1]], right[to[r] : to[r + 1]]
                if len(a) + len(b) > 1:
                    rows = pa.concat_arrays([a, b]) if len(b) else a
                    node = rows.field("gm_node").to_numpy(zero_copy_only=False)
                    out += [(int(node[x]), int(node[y])) for x, y in links_of(rows, len(a)) if node[x] != node[y]]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = groups.select("gm_left", "gm_right").mapInArrow(work, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(cells: DataFrame, wide: DataFrame | Callable, near: Callable[[pa.StructArray], Near], block: int, finer: Callable[[DataFrame], DataFrame] | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, str]:
    """Edges (a, b) enough to connect all nodes that share a cell and are ``near``; stored, and its path.

    ``cells``: gm_node, gm_size (bytes of its row of ``wide``), gm_t (the table) and gm_cell.  ``wide``: gm_node and what ``near``
    compares, or a function that reads it for the nodes that share a cell at all.  ``finer`` makes the cells of rows of large cells;
    ``again`` makes cells of the nodes outside the largest component, where these alone are more than ``APART`` blocks of a cell.
    """
    spark = cells.sparkSession
    met, met_path = _met(cells, block)
    rows, wide_path = wide(met) if callable(wide) else (wide, None)
    names = rows.columns
    row = F.struct(*names)
    joined = lambda df: df.join(rows, "gm_node") if names != ["gm_node"] else df

    # every block of every cell by itself: all of a cell that is one block
    part = F.pmod(F.xxhash64("gm_node", "gm_cell"), F.col("gm_parts"))
    blocks = joined(met.select("gm_node", "gm_cell", part.alias("gm_part"))).groupBy("gm_cell", "gm_part")
    groups = blocks.agg(F.collect_list(row).alias("gm_left"), F.array().cast("array<struct<gm_node:bigint>>").alias("gm_right"))
    first, path = _few(_mapped(groups, lambda r, n: forest(len(r), near(r))), "links", met_path)
    spent = [p for p in (met_path, wide_path) if p]
    large = met.filter("gm_parts > 1")
    if large.isEmpty():
        delete(spark, *spent)
        return first, path

    # cells of several blocks: nodes outside the cell's largest component with those inside, and with each other
    roots, used = components(first)
    if finer is not None:
        fine, fine_path = _met(finer(large), block)
        large, spent = fine, [*spent, fine_path]
    labelled = large.join(roots, F.col("gm_node") == F.col("node"), "left").select("gm_node", "gm_size", "gm_cell", F.coalesce("root", "gm_node").alias("gm_root"))
    kept, kept_path = stored(labelled, "labelled")
    sums = kept.groupBy("gm_cell", "gm_root").agg(F.count("*").alias("n"), F.sum("gm_size").alias("s"))
    sums = sums.groupBy("gm_cell").agg(F.max_by("gm_root", F.struct("n", "gm_root")).alias("gm_major"), F.max("n").alias("n"), F.max_by("s", F.struct("n", "gm_root")).alias("s"), F.sum("n").alias("gm_n"), F.sum("s").alias("gm_s"))
    sums = sums.filter("gm_n > n").withColumn("gm_rest", F.col("gm_n") - F.col("n")).withColumn("gm_rest_s", F.col("gm_s") - F.col("s"))
    sums, sums_path = stored(sums.select("gm_cell", "gm_major", _parts("n", "s", block).alias("gm_p"), _parts("gm_rest", "gm_rest_s", block).alias("gm_q")), "majors")
    here = kept.join(sums, "gm_cell").withColumn("gm_in", F.col("gm_root") == F.col("gm_major"))
    mine = F.pmod(F.xxhash64("gm_node", "gm_cell"), F.when(F.col("gm_in"), F.col("gm_p")).otherwise(F.col("gm_q"))).cast("int")
    here = here.withColumn("gm_mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("gm_in"), F.col("gm_q")).otherwise(F.col("gm_p")) - 1))
    across = here.withColumn("gm_other", other).select(
        "gm_node", "gm_root", "gm_cell", F.when(F.col("gm_in"), F.col("gm_mine")).otherwise(F.col("gm_other")).alias("gm_i"),
        F.when(F.col("gm_in"), F.col("gm_other")).otherwise(F.col("gm_mine")).alias("gm_j"), F.col("gm_in").alias("gm_first"), F.lit(True).alias("gm_across"),
    )
    outside = here.filter("not gm_in")
    third, third_path = None, []
    if again is not None:
        many = outside.filter(F.col("gm_q") > APART)
        if not many.isEmpty():
            third, path_of_third = _linked(again(many.select("gm_node", "gm_size", "gm_cell")), rows, near, block)
            third_path = [path_of_third]
        outside = outside.filter(F.col("gm_q") <= APART)
    among = outside.withColumn("gm_other", F.explode(F.sequence(F.lit(0), F.col("gm_q") - 1)))
    i, j = F.least("gm_mine", "gm_other"), F.greatest("gm_mine", "gm_other")
    among = among.select("gm_node", "gm_root", "gm_cell", i.alias("gm_i"), j.alias("gm_j"), (F.col("gm_mine") == i).alias("gm_first"), F.lit(False).alias("gm_across"))
    full = joined(across.unionByName(among))
    side = F.struct(*names, "gm_root")
    groups = full.groupBy("gm_cell", "gm_across", "gm_i", "gm_j").agg(F.collect_list(F.when(F.col("gm_first"), side)).alias("gm_left"), F.collect_list(F.when(~F.col("gm_first"), side)).alias("gm_right"))

    def joins(rows: pa.StructArray, n: int) -> list[tuple[int, int]]:
        label, every = rows.field("gm_root").to_numpy(zero_copy_only=False), np.arange(len(rows))
        return bridges(every[:n], every[n:], label, near(rows)) if n < len(rows) else bridges(every, every, label, near(rows))

    second, second_path = _few(_mapped(groups, joins), "links", kept_path)
    every = first.union(second) if third is None else first.union(second).union(third)
    both, both_path = _few(every.distinct(), "links", path, second_path, *third_path)
    delete(spark, path, second_path, kept_path, sums_path, *third_path, *spent, *used)
    return both, both_path


def links(nodes: DataFrame, radius: int = 4, block: int = 8 * BLOCK) -> tuple[DataFrame, str]:
    """Edges (a, b) between the longs ``gm_node``, enough to connect all that lie within ``radius`` bits; stored, and its path."""
    masks = covering_masks(radius)

    def cells(rows: DataFrame, within: list, masks_of: Column) -> DataFrame:
        """A cell is named by the hash of its tables and masked word; should two names meet, their nodes are compared in vain."""
        every = rows.select(*within, F.posexplode(masks_of).alias("gm_t", "gm_mask"))
        return every.select("gm_node", F.lit(8).cast("long").alias("gm_size"), "gm_t", F.xxhash64(*within[1:], "gm_t", F.col("gm_node").bitwiseAND(F.col("gm_mask"))).alias("gm_cell"))

    finer = F.array(*[F.array(*map(F.lit, covering_masks(radius, ~m))) for m in masks])
    spread = nodes.select("gm_node").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a node makes many rows
    return _linked(
        cells(spread, ["gm_node"], F.array(*map(F.lit, masks))), nodes.select("gm_node"), lambda rows: _prints_near(rows, radius), block,
        lambda large: cells(large.select("gm_node", "gm_cell", F.element_at(finer, F.col("gm_t") + 1).alias("gm_masks")), ["gm_node", "gm_cell"], F.col("gm_masks")),
    )


def _few(df: DataFrame, name: str, *sources: str) -> tuple[DataFrame, str]:
    """``stored`` for narrow rows that come from the tables at ``sources``: in a file for 16 MB of these, so not in very many."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.coalesce(min(parts, 1 + sum(size_of(df.sparkSession, s) for s in sources) // (16 << 20))), name)


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows (node, root) of every node that has an edge; root is the least node of its component.

    Alternates large-star and small-star contraction until the edges are stars.  Each
    round is written to the shared folder, so lineage stays short; the paths of the
    tables that the result still reads are returned for clean-up.
    """
    spark = edges.sparkSession
    now, path = stored(edges, "edges")
    before: tuple = ()
    while True:
        # the least neighbours are stored too: a join of plain exchanges is split where a node has very many neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least, one = _few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", path)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, two = _few(large, "large", path)
        least, three = _few(large.groupBy("u").agg(F.min("v").alias("m")), "least", path)
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"), F.col("m").alias("a"))
        step = small.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh, fresh_path = _few(step, "edges", path)
        delete(spark, path, one, two, three)
        now, path = fresh, fresh_path
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(sums) == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")), [path]
        before = tuple(sums)


def _grouped(nodes: DataFrame, edges: tuple[DataFrame, str], *keys: str) -> tuple[DataFrame, str]:
    """``keys`` of all nodes, gm_root, which names the component, and component_id, the least gm_least in it; stored, and its path."""
    roots, used = components(edges[0])
    placed = nodes.join(roots, F.col("gm_node") == F.col("node"), "left").select(*keys, "gm_least", F.coalesce("root", "gm_node").alias("gm_root"))
    least, path = _few(placed.groupBy("gm_root").agg(F.min("gm_least").alias("component_id")), "least", *used)
    known = stored(placed.join(least, "gm_root").select(*keys, "gm_root", "component_id"), "components")
    delete(nodes.sparkSession, path, edges[1], *used)
    return known


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, block: int = 8 * BLOCK
) -> DataFrame:
    """One row per row of ``df``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints within ``radius`` bits are linked; component_id is the least id that
    can be reached over links.
    """
    prints, _ = stored(fingerprints(df, id_col, text_col, width), "fingerprints")
    nodes = prints.groupBy(F.col("gm_fp").alias("gm_node")).agg(F.min("gm_id").alias("gm_least"))
    known, _ = _grouped(nodes, links(nodes.select("gm_node"), radius, block), "gm_node")
    return prints.join(known, F.col("gm_fp") == F.col("gm_node")).select(
        F.col("gm_id").alias(id_col), F.lower(F.lpad(F.hex("gm_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


_NAMES = [f"gm_b{k}" for k in range(BANDS)]


def _row_names(df: DataFrame) -> list[Column]:
    """gm_r1 and gm_r2, 128 bits that name a row with all its columns."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return [F.xxhash64(*plain).alias("gm_r1"), F.xxhash64(F.lit("row"), *plain).alias("gm_r2")]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """gm_id, gm_text and ``_row_names``."""
    return df.select(F.col(f"`{id_col}`").alias("gm_id"), F.col(f"`{text_col}`").cast("string").alias("gm_text"), *_row_names(df))


def sketches(rows: DataFrame, width: int = 5) -> DataFrame:
    """gm_id, gm_r1, gm_r2, 128 bits that name the shingle set (gm_k1, gm_k2), gm_n, its size, gm_fp, its fingerprint as a signed long, and its bands of every row of ``_keyed``."""
    small_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in texts(batch.column(1))]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets), dtype="<i8").reshape(-1, 2)
            prints = [_signed(set_fingerprint(s)) for s in sets]
            bands = np.stack([minhashes(s) for s in sets]).view("<i4") if sets else np.zeros((0, BANDS), dtype="<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.int64()), *map(pa.array, bands.T)],
                names=["gm_id", "gm_r1", "gm_r2", "gm_k1", "gm_k2", "gm_n", "gm_fp", *_NAMES],
            )

    kind = rows.schema["gm_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"gm_id {kind}, gm_r1 long, gm_r2 long, gm_k1 long, gm_k2 long, gm_n long, gm_fp long, " + ", ".join(f"{n} int" for n in _NAMES))


#: Words of 64 bits in the bitmap of ``_sifted``.
_WORDS = 1 << 20


def _sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose gm_r1 may be in ``wanted``, so that few texts are shuffled to be joined with it.

    A bitmap of 2^26 bits by hash, as a table of at most 2^20 words, which bounds what is broadcast: in very large tables more rows that aren't wanted pass,
    never fewer that are.
    """
    word, bit = F.shiftrightunsigned("gm_r1", 6).bitwiseAND(F.lit(_WORDS - 1)), F.expr("shiftleft(1L, cast(gm_r1 & 63 as int))")
    words = wanted.groupBy(word.alias("gm_word")).agg(F.bit_or(bit).alias("gm_bits"))
    return rows.join(F.broadcast(words), word == F.col("gm_word")).filter(F.col("gm_bits").bitwiseAND(bit) != 0).drop("gm_word", "gm_bits")


def _read_sets(rows: DataFrame, nodes: DataFrame, width: int = 5) -> Callable[[DataFrame], tuple[DataFrame, str]]:
    """For ``_linked``: gm_node, gm_fp, gm_marks and gm_set of the nodes that share a cell, from one text of each, read again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in texts(batch.column(2))]
            short = [np.unique(s & np.uint64((1 << 48) - 1)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([minhashes(s).tobytes() for s in sets], pa.binary()), pa.array(map(packed, short), pa.binary())],
                names=["gm_node", "gm_fp", "gm_marks", "gm_set"],
            )

    def read(met: DataFrame) -> tuple[DataFrame, str]:
        wanted, path = stored(nodes.join(met.select("gm_node").distinct(), "gm_node", "left_semi").select("gm_node", "gm_fp", "gm_r1", "gm_r2"), "wanted")
        chosen = _sifted(rows, wanted).join(wanted, ["gm_r1", "gm_r2"]).dropDuplicates(["gm_r1", "gm_r2"]).select("gm_node", "gm_fp", "gm_text")
        sets = stored(chosen.mapInArrow(work, "gm_node long, gm_fp long, gm_marks binary, gm_set binary"), "sets")
        delete(rows.sparkSession, path)
        return sets

    return read


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, radius: int = RADIUS, least: int = LEAST) -> DataFrame:
    """One row per row of ``df``: gm_id, gm_r1 and gm_r2 (128 bits that name the row), gm_root, which names the component, and component_id, by similarity of 0.8 or more.

    Pairs within ``radius`` bits are compared by way of the covering masks, others by way of the bands if ``least`` MinHashes agree.
    """
    spark = df.sparkSession
    rows = _keyed(df, id_col, text_col)
    prints, prints_path = stored(sketches(rows), "sketches")
    # a node is a set, named by a number of its own once its table is written, and has one of its rows to be read again
    lowest = [F.min("gm_id").alias("gm_least"), F.min("gm_r1").alias("gm_r1"), F.min_by("gm_r2", "gm_r1").alias("gm_r2")]
    sets = prints.groupBy("gm_k1", "gm_k2").agg(*lowest, *[F.first(c).alias(c) for c in ["gm_n", "gm_fp", *_NAMES]])
    nodes, path = stored(sets.withColumn("gm_node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.filter("gm_n > 0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a node makes many rows
    bands = [F.col(n).cast("long") for n in _NAMES]
    masked = [F.col("gm_fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)]
    cells = spread.select("gm_node", (6 * F.col("gm_n") + BANDS * ROWS + 8).alias("gm_size"), F.posexplode(F.array(*bands, *masked)).alias("gm_t", "gm_band"))
    cells = cells.select("gm_node", "gm_size", "gm_t", F.xxhash64("gm_t", "gm_band").alias("gm_cell"))

    def again(outside: DataFrame) -> DataFrame:
        """Cells of nodes that share a band beside what names their cell, a band or a masked fingerprint."""
        banded = outside.join(nodes.select("gm_node", F.array(*bands).alias("gm_bands")), "gm_node")
        banded = banded.select("gm_node", "gm_size", "gm_cell", F.posexplode("gm_bands").alias("gm_t", "gm_band")).withColumn("gm_name", F.xxhash64("gm_t", "gm_band"))
        return banded.filter("gm_name <> gm_cell").select("gm_node", "gm_size", "gm_t", F.xxhash64("gm_cell", "gm_name").alias("gm_cell"))

    found = _linked(cells, _read_sets(rows, nodes), lambda r: _sets_near(r, radius, least), block, again=again)
    known, known_path = _grouped(nodes, found, "gm_k1", "gm_k2")
    groups, _ = stored(prints.join(known, ["gm_k1", "gm_k2"]).select("gm_id", "gm_r1", "gm_r2", "gm_root", "component_id"), "groups")
    delete(spark, prints_path, path, known_path)
    return groups


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with all their columns, of which one stays for each group of near copies: that with the least id
    (null ids last), then the least hash of the whole row.  Repeated rows are one."""
    groups = near_groups(df, id_col, text_col, **options)
    first = groups.groupBy("gm_root").agg(F.min(F.struct(F.col("gm_id").isNull().alias("n"), "gm_id", "gm_r1", "gm_r2")).alias("gm_first"))
    keep = first.select("gm_first.gm_r1", "gm_first.gm_r2")
    plain = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("gm_row"), *_row_names(df))
    return plain.join(keep, ["gm_r1", "gm_r2"]).dropDuplicates(["gm_r1", "gm_r2"]).select("gm_row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 4-word shingles, links at 4 or fewer bits."""
    return simhash_groups(documents(spark, sf_dir))
