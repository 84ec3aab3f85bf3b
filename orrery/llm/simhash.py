"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared as numpy tiles: exclusive-or, bit counts, and tile
pairs whose population counts differ by more than the radius are skipped.
Tiles are cut inside groups of fingerprints that agree on one of radius + 1
bit blocks. Two fingerprints within the radius agree on at least one block,
so no link is lost, and the work per document does not grow with the corpus
as it would over all tile pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import cut, small, table
from orrery.llm.components import components

BITS = 64
#: Rows of a numpy tile, and the most that a group holds before it is split into cells.
TILE, GROUP = 256, 4096
#: Words of a wide fingerprint, and the bands that bring its rows together: so many, of so many bits each.
WIDE, BANDS, BAND_BITS = 8, 64, 14
#: Doubtful pairs of a cell that are held before they are cut down to a spanning forest.
FOREST = 1 << 18
#: Bytes of shingle sets that are broadcast to the pairs at most; more are joined.
SETS = 16 << 20
#: Standard deviations within which a wide fingerprint's estimate is held against the shingle sets themselves.
STRAY = 3


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes (uint64) of a text's ``width``-word shingles, repeats included; fewer words make one, no words none."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if words else [], np.uint64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begins = [0, *(spaces[: len(words) - width] + 1).tolist()]
    ends = [*spaces[width - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(begins, ends, strict=True)), np.uint64, len(begins))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of uint64 words, the bits that over half the rows have, as words."""
    ones = np.zeros(BITS * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash over ``width``-word shingles (null or no words: 0)."""
    return int(_majority(shingles(text, width)[:, None])[0])


def wide_fingerprint(text: str | None, width: int = 5) -> bytes:
    """SimHash of WIDE words over the set of shingles; each word mixes the shingle's hash anew (splitmix64)."""
    x = np.unique(shingles(text, width))[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(x ^ (x >> np.uint64(31))).tobytes()


def radii_of(alike: float) -> tuple[int, int]:
    """Differing bits of wide fingerprints: up to the first, sets surely have a Jaccard similarity of ``alike``; beyond the second, surely not.

    Equal-sized sets of similarity J have the cosine 2J / (1 + J), and a bit
    differs with the probability angle / pi. The radii lie STRAY standard
    deviations of the count to either side of its mean.
    """
    p = np.arccos(2 * alike / (1 + alike)) / np.pi
    mean, stray = WIDE * BITS * p, STRAY * np.sqrt(WIDE * BITS * p * (1 - p))
    return max(0, int(mean - stray)), int(mean + stray)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, wide: bool = False) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed long, a wide one as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if wide:
                fps = pa.array([wide_fingerprint(t, width) for t in texts], pa.binary())
            else:
                fps = pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, fp {'binary' if wide else 'long'}")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(offset, width) of the radius + 1 bit blocks."""
    n = radius + 1
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _within(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of row indexes, from left and right, of fingerprints (rows of uint64 words) within the radius, and their distances.

    Every row of left is compared with every row of right, tile by tile, in
    order of population count; tiles whose counts differ by more are skipped.
    """
    pop = np.bitwise_count(fp).sum(1, dtype=np.int64)
    left, right = (x[np.argsort(pop[x], kind="stable")] for x in (left, right))
    for p in range(0, len(left), TILE):
        a = left[p : p + TILE]
        for q in range(0, len(right), TILE):
            b = right[q : q + TILE]
            if pop[b[0]] - pop[a[-1]] > radius:
                break
            if pop[a[0]] - pop[b[-1]] > radius:
                continue
            apart = np.zeros((len(a), len(b)), np.uint16)
            for w in fp.T:
                apart += np.bitwise_count(w[a][:, None] ^ w[b][None, :])
            i, j = np.nonzero(apart <= radius)
            yield a[i], b[j], apart[i, j]


def linked(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Of a cell's fingerprints, the index of the root of each within the cell's links between left and right."""
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j, _ in _within(fp, left, right, radius):
        x, y = root[i], root[j]
        if (differ := x != y).any():
            for pair in np.unique(x[differ] * len(fp) + y[differ]).tolist():
                u, v = find(pair // len(fp)), find(pair % len(fp))
                root[max(u, v)] = min(u, v)
            while (root[root] != root).any():
                root = root[root]
    return root


def _words(fp: pa.ChunkedArray) -> np.ndarray:
    """Longs or binaries as rows of uint64 words."""
    if pa.types.is_integer(fp.type):
        return np.ascontiguousarray(fp.to_numpy()).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(fp), -1)


def _by_cell(cell):
    """Runs ``cell`` (a table to batches) on the rows of each cell; a cell may span Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[not held or held[-1].column(0)[0].as_py() != keys[0]], keys[1:] != keys[:-1]])).tolist()
            first = starts[0] if starts else len(keys)
            if first:
                held.append(batch.slice(0, first))
            for at, end in zip(starts, [*starts[1:], len(keys)] if starts else [], strict=True):
                if held and sum(x.num_rows for x in held) > 1:
                    yield from cell(pa.Table.from_batches(held))
                held = [batch.slice(at, end - at)]
        if held and sum(x.num_rows for x in held) > 1:
            yield from cell(pa.Table.from_batches(held))

    return run


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    side = rows.column("side").to_numpy()
    return _words(rows.column("fp")), np.flatnonzero(side & 1), np.flatnonzero(side & 2)


def _links(radius: int):
    def cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, root = rows.column("node").to_numpy(), linked(*_sides(rows), radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["a", "b"])

    return _by_cell(cell)


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of links (i, j), those of a spanning forest of least distances between the parts that ``root`` tells (Kruskal, a distance at a time)."""
    root, chosen = root.copy(), []
    order = np.argsort(apart, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(apart[order])) + 1):
        level = level[root[i[level]] != root[j[level]]]
        if not len(level):
            continue
        _, first = np.unique(root[i[level]] * len(root) + root[j[level]], return_index=True)
        for k in level[first].tolist():
            u, v = i[k], j[k]
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            if u != v:
                root[max(u, v)] = min(u, v)
                chosen.append(k)
        while (root[root] != root).any():
            root = root[root]
    return np.array(chosen, np.int64)


def _doubtful(sure: int, radius: int, parts: bool = False):
    """Of each cell a star for each part that the sure radius links (firm), and a spanning forest of the other pairs within the radius.

    With ``parts``, rows tell the part that they are known to belong to, and
    all pairs within the radius of different parts come instead. A pair counts
    in the cell of the first band that its fingerprints share, not in the later
    ones.
    """
    masks = np.zeros((BANDS, WIDE * BITS), np.uint8)
    for mask, pick in zip(masks, _picks(), strict=True):
        mask[pick] = 1
    masks = np.packbits(masks, axis=1, bitorder="little").view(np.uint64)

    def out(a: np.ndarray, b: np.ndarray, firm: bool, cell: int) -> pa.RecordBatch:
        columns = [np.minimum(a, b), np.maximum(a, b), np.full(len(a), firm), np.full(len(a), cell)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "firm", "cell"])

    def first_met(rows: pa.Table, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        node, (fp, left, right) = rows.column("node").to_numpy(), _sides(rows)
        band, same = rows.column("band")[0].as_py(), rows.column("side")[0].as_py() == 3
        for i, j, apart in _within(fp, left, right, radius):
            open_ = root[i] != root[j]
            if same:  # each pair comes twice
                open_ &= node[i] < node[j]
            i, j, apart = i[open_], j[open_], apart[open_]
            for mask in masks[:band]:
                if not len(i):
                    break
                new = (((fp[i] ^ fp[j]) & mask) != 0).any(1)
                i, j, apart = i[new], j[new], apart[new]
            if len(i):
                yield i, j, apart

    def cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        node, key = rows.column("node").to_numpy(), rows.column("cell")[0].as_py()
        if parts:
            _, root = np.unique(rows.column("part").to_numpy(), return_inverse=True)
            for i, j, _ in first_met(rows, root):
                yield out(node[i], node[j], False, key)
            return
        root = linked(*_sides(rows), sure)
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield out(node[moved], node[root[moved]], True, key)
        held, size = [], 0
        for found in first_met(rows, root):
            held.append(found)
            size += len(found[0])
            if size > FOREST:
                # A forest of a forest and further links is one of all of them.
                held = [_pruned(root, held)]
                size = 0
        if held:
            i, j, _ = _pruned(root, held)
            yield out(node[i], node[j], False, key)

    return _by_cell(cell)


def _pruned(root: np.ndarray, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, apart = (np.concatenate(x) for x in zip(*held, strict=True))
    chosen = _forest(root, i, j, apart)
    return i[chosen], j[chosen], apart[chosen]


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(node, fp) with distinct fp -> links (a, b) between nodes within ``radius`` bits.

    The links of a cell are given as a star for each of its connected parts, so
    a dense group gives no more links than it has members; joined over all
    cells they connect just what all pairs within the radius connect.
    """
    keyed = nodes.select(
        "node",
        "fp",
        F.explode(F.array(*[F.shiftrightunsigned(F.col("fp"), at).bitwiseAND((1 << w) - 1).cast("long") + F.lit(i << (BITS // (radius + 1) + 1)) for i, (at, w) in enumerate(_blocks(radius))])).alias("block"),
        F.bit_count("fp").alias("pop"),
    )
    # Few blocks exist whatever the corpus: at most (radius + 1) * 2 ** 13 rows here for radius 4.
    crowded = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
    crowded = crowded.select("block", F.ceil(F.col("n") / (4.0 * GROUP)).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(crowded) if radius >= 4 else crowded, "block", "left")
    plain = dealt.where("parts IS NULL").select(F.xxhash64("block").alias("cell"), "node", "fp", F.lit(3).alias("side"), "pop")
    # A crowded block becomes tile pairs: part (pop, s) against part (pop', s') for pop <= pop' <= pop + radius.
    split = dealt.where("parts IS NOT NULL").withColumn("s", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    split = split.select("*", F.explode(F.expr(f"sequence(pop - {radius}, pop + {radius})")).alias("pop2"), F.expr("sequence(0, parts - 1)").alias("ss"))
    split = split.select("*", F.explode("ss").alias("s2"))
    mine, other = F.struct(F.col("pop").cast("int").alias("p"), F.col("s").alias("s")), F.struct(F.col("pop2").cast("int").alias("p"), F.col("s2").alias("s"))
    split = split.select(
        F.xxhash64(F.col("block"), F.least(mine, other), F.greatest(mine, other)).alias("cell"),
        "node",
        "fp",
        F.when(mine == other, 3).when(mine < other, 1).otherwise(2).alias("side"),
        "pop",
    )
    cells = plain.union(split).select("cell", "node", "fp", "side", "pop")
    cells = cells.repartition("cell").sortWithinPartitions("cell", "pop")
    return cells.mapInArrow(_links(radius), "a long, b long")


def _picks() -> np.ndarray:
    """The bits of each band."""
    rng = np.random.default_rng(11)
    return np.array([rng.choice(WIDE * BITS, BAND_BITS, replace=False) for _ in range(BANDS)])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, more) -> (block, fp, more) for each band: the band's number and its bits."""
    picks = _picks()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            bits = np.unpackbits(_words(pa.chunked_array([part.column(0)])).view(np.uint8), axis=1, bitorder="little")
            for band, pick in enumerate(picks):
                key = bits[:, pick].astype(np.int64) @ (1 << np.arange(BAND_BITS, dtype=np.int64)) + (band << BAND_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], ["block", *part.schema.names])


def _meet(nodes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(node, fp[, part]) with distinct wide fp -> rows of cells, those of one cell together: cell, node, fp, side, band[, part].

    A cell is a value of a band. At a Jaccard similarity of 0.8 two fingerprints
    agree on a band with probability 0.1, and on one of all bands with 0.999.
    A crowded value is dealt into parts, each of which meets each. ``only``
    names the cells that are wanted, if not all are.
    """
    extra = [c for c in nodes.columns if c == "part"]
    keyed = nodes.select("fp", "node", *extra).mapInArrow(_banded, "block long, fp binary, node long" + ", part long" * len(extra))
    # At most BANDS * 2 ** BAND_BITS (a million) band values exist, whatever the corpus.
    crowded = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
    crowded = crowded.select("block", F.ceil(F.col("n") / (0.5 * GROUP)).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(crowded), "block", "left")
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")).alias("s2"))
    side = F.when(F.col("s") == F.col("s2"), 3).when(F.col("s") < F.col("s2"), 1).otherwise(2)
    cells = dealt.select(F.xxhash64("block", F.least("s", "s2"), F.greatest("s", "s2")).alias("cell"), "node", "fp", side.alias("side"), F.shiftright("block", BAND_BITS).cast("int").alias("band"), *extra)
    if only is not None:
        cells = cells.join(small(only), "cell", "left_semi")
    return cells.repartition("cell").sortWithinPartitions("cell")


def _sets(width: int):
    """(node, text) -> (node, the text's distinct shingle hashes in order, as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, width)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "set"])

    return run


def _verified(alike: float):
    """(a, b, their sets) -> the (a, b) of which the sets have a Jaccard similarity of ``alike`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                holds.append(both >= alike * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(holds, pa.bool_()))

    return run


def _between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that lie between different parts (node, component)."""
    columns = pairs.columns
    for end in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}")), end, "left")
    return pairs.where("coalesce(part_a, a) <> coalesce(part_b, b)").select(*columns)


def _checked(pairs: DataFrame, texts: DataFrame, width: int, alike: float) -> DataFrame:
    """Of pairs (a, b) those whose shingle sets have a similarity of ``alike`` or more."""
    # As many numbers as may be broadcast spare the texts a shuffle.
    wanted = small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = cut(texts.join(wanted, "node", "left_semi").mapInArrow(_sets(width), "node long, set binary"))
    if (sets.agg(F.sum(F.length("set"))).head()[0] or 0) <= SETS:
        sets = F.broadcast(sets)
    held = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return held.select("a", "b", "x", "y").mapInArrow(_verified(alike), "a long, b long")


def _alike(nodes: DataFrame, texts: DataFrame, width: int, alike: float) -> DataFrame:
    """(node, fp) with distinct wide fp, (node, text) -> links (a, b) that connect what all links of a Jaccard similarity of ``alike`` or more do.

    Pairs within the sure radius link. Of the others each cell first gives a
    spanning forest, which is checked on the shingle sets. Two alike texts
    that this leaves in different parts are joined by a path of their cell's
    forest, one of whose links was refuted and lies between parts. So in the
    cells of such links, and only there, all pairs between parts are checked.
    """
    sure, doubtful = radii_of(alike)
    found = "a long, b long, firm boolean, cell long"
    near = cut(_meet(nodes).mapInArrow(_doubtful(sure, doubtful), found))
    parts = cut(components(near.where("firm").select("a", "b").distinct()))
    pairs = cut(_between(near.where("NOT firm").select("a", "b", "cell"), parts))
    star = parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    parts = cut(components(star.union(_checked(pairs.select("a", "b"), texts, width, alike))))
    star = parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    refuted = cut(_between(pairs, parts).select("cell").distinct())
    if not refuted.head(1):
        return star
    named = nodes.join(parts, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("part"))
    rest = cut(_meet(named, refuted).mapInArrow(_doubtful(sure, doubtful, True), found).select("a", "b"))
    return star.union(_checked(rest, texts, width, alike))


def _grouped(marks: DataFrame, link) -> DataFrame:
    """(doc_id, fp) -> also component_id; ``link`` gives the links between (node, fp)."""
    marks = cut(marks)
    nodes = cut(marks.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")))
    # A repeated doc_id with two texts is one document: its fingerprints share a component.
    twice = marks.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    shared = marks.join(twice, "doc_id", "left_semi").distinct().join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    parts = components(link(nodes).union(shared))
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marks.join(named, "fp", "left")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z) and cut into words; fewer than ``width`` words
    make one shingle, a null or wordless text has the fingerprint zero and is
    linked like any other. Rows of equal doc_id each give a row; a null doc_id
    gives a row whose component is the group's least known doc_id (null if none
    is known). An empty table gives no rows; other columns are not read.
    """
    out = _grouped(fingerprints(docs, text, doc_id, width), lambda nodes: links(nodes, radius))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, alike: float = 0.8) -> DataFrame:
    """One row per document: doc_id, component_id, by links of a Jaccard similarity of ``alike`` and more.

    The sets are those of ``width``-word shingles. Wide fingerprints find the
    pairs; unless they tell much more than ``alike``, the sets decide. Of 1000
    pairs that are just ``alike``, about one shares no band and is not found
    directly. Odd rows are taken as near_duplicates takes them.
    """
    marks = fingerprints(docs, text, doc_id, width, wide=True)
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    return _grouped(marks, lambda nodes: _alike(nodes, texts, width, alike)).select("doc_id", "component_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The documents of which doc_id is the least of its group of ``similar`` ones, all columns kept.

    Rows that share that doc_id are copies: the first in text order stays. Rows
    without doc_id can't be named and stay.
    """
    found = similar(docs, **params)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return named.withColumn("__first", first).where("__first = 1").drop("__first").unionByName(docs.where("doc_id IS NULL"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
