"""SimHash near-duplicates: fingerprints, links found in a space of segment bit counts, components.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. Fingerprints that differ in at
most 4 bits are at most 4 apart there under Manhattan distance, so their counts differ in 4 segments at
most, and of eight groups of segments at least four are equal coordinate by coordinate: points are dealt
to the 70 grids which four groups span, and only points in one cell are compared, first by the Manhattan
distance and then bit by bit. The points of a large cell agree on its groups; among the other segments
the same holds for six smaller groups, of which two at least are equal, so the cell is dealt to 15 finer
grids, and a large cell of those once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.llm import arrays as A
from opinaria.llm.steps import written
from opinaria.sources.scratch import materialise

SHINGLE, MOST_BITS, SEGMENT_BITS, SEGMENTS = 4, 4, 2, 32
# Groups of a grid's free segments, level by level: all but MOST_BITS of them are equal in linked points.
GROUPS = (8, 6, 6)
# A cell with more points is dealt to finer grids; on the last level it is compared in blocks of this many.
BLOCK = 512
LOW_BITS = 0x5555555555555555


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Majority of the bits of XXH64 (seed 42) over all shingles; no word gives zero."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 4096):
        part = hashes[a : a + 4096].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > len(hashes)).tolist())


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(_id, fp): A-Z are lower-cased; a null text is an empty one."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        A.give_back()
        for batch in (part for whole in batches for part in A.slices(whole, "_text")):
            prints = [fingerprint((t or "").encode().lower().split(), shingle) for t in batch["_text"].to_pylist()]
            values = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(values)], names=["_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(hashed, "_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of all two-bit segments, packed into one long: 0, 1 or 2 each."""
    low = fp.bitwiseAND(F.lit(LOW_BITS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of the differences of packed counts, which the number of differing bits never undercuts.

    A segment's counts differ by 2 if both of their bits differ (0 and 2), else by their lowest bits.
    """
    apart = a.bitwiseXOR(b)
    ones = apart.bitwiseAND(F.lit(LOW_BITS))
    twos = F.shiftrightunsigned(apart, 1).bitwiseAND(F.lit(LOW_BITS))
    # 1 against 2 flips both bits of the packed count, yet differs by one.
    twos = twos.bitwiseAND(F.bitwise_not(ones))
    return F.bit_count(ones) + 2 * F.bit_count(twos)


def finer(fixed: frozenset[int], groups: int) -> list[frozenset[int]]:
    """The segments that each grid below a grid fixes: its own and all but MOST_BITS groups of the free ones."""
    free = [s for s in range(SEGMENTS) if s not in fixed]
    cuts = [round(i * len(free) / groups) for i in range(groups + 1)]
    parts = [free[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [fixed.union(*chosen) for chosen in combinations(parts, groups - MOST_BITS)]


def grids() -> list[list[frozenset[int]]]:
    """The fixed segments of the grids of each level; those below grid i of a level follow one another."""
    levels = [finer(frozenset(), GROUPS[0])]
    for groups in GROUPS[1:]:
        levels.append([below for fixed in levels[-1] for below in finer(fixed, groups)])
    return levels


def mask_of(fixed: frozenset[int]) -> int:
    """The bits of the packed counts that make a cell, as a long."""
    mask = sum(3 << (SEGMENT_BITS * s) for s in fixed)
    return mask - (1 << 64) if mask >> 63 else mask


def first_grid(a: Column, b: Column) -> Column:
    """The number of the first grid of the first level in which two points share a cell."""
    apart = a.bitwiseXOR(b)
    tests = [F.when(apart.bitwiseAND(F.lit(mask_of(m))) == 0, F.lit(i)) for i, m in enumerate(grids()[0])]
    return F.coalesce(*tests)


def cells(points: DataFrame) -> DataFrame:
    """(fp, counts, grid, cell): every distinct fingerprint in each grid of the first level."""
    counts = points.withColumn("counts", segment_counts(F.col("fp")))
    spans = [F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(mask_of(m))).alias("cell"))
             for i, m in enumerate(grids()[0])]
    return counts.select("fp", "counts", F.inline(F.array(*spans)))


def finer_cells(large: DataFrame, level: int) -> DataFrame:
    """(fp, counts, grid, cell) of points in large cells, in the grids below theirs.

    The grids of a level are a fixed number: 1,050 and 15,750.
    """
    masks = grids()[level]
    below = len(masks) // len(grids()[level - 1])
    table = large.sparkSession.createDataFrame(
        [(i // below, i, mask_of(m)) for i, m in enumerate(masks)], "grid int, finer int, mask long")
    return large.select("fp", "counts", "grid").join(F.broadcast(table), "grid").select(
        "fp", "counts", F.col("finer").alias("grid"), F.col("counts").bitwiseAND(F.col("mask")).alias("cell"))


def chained_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each unit (unit: grid, cell, pair of blocks) that join the same points as all links do.

    Units arrive one after another. Each component of a unit becomes a chain of pairs.
    """
    rest: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        fp = np.unique(np.asarray(table["fp"]).astype(np.int64)).view(np.uint64)
        label = np.arange(len(fp))
        near = []
        for a in range(0, len(fp), 256):
            near.append(np.bitwise_count(fp[a : a + 256, None] ^ fp[None, :]) <= MOST_BITS)
        adjacent = np.concatenate(near)
        while True:
            least = np.where(adjacent, label[None, :], len(fp)).min(axis=1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        order = np.argsort(label, kind="stable")
        same = label[order][1:] == label[order][:-1]
        values = fp.view(np.int64)
        pairs = [pa.array(values[order][:-1][same]), pa.array(values[order][1:][same])]
        return pa.RecordBatch.from_arrays(pairs, names=["a", "b"])

    for batch in batches:
        rest.append(batch)
        table = pa.Table.from_batches(rest)
        keys = np.stack([np.asarray(table[c]).astype(np.int64) for c in ("grid", "cell", "i", "j")], 1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        edges = [0, *cut.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield links(table.slice(a, b - a))
        rest = table.slice(edges[-1]).to_batches()
    if rest and (table := pa.Table.from_batches(rest)).num_rows:
        yield links(table)


def cell_pairs(small: DataFrame, per_first: int) -> DataFrame:
    """(a, b): the links inside cells, each only where the first grid that both points share leads.

    ``per_first`` is the number of grids below one of the first level.
    """
    other = small.select("grid", "cell", F.col("fp").alias("fp_2"), F.col("counts").alias("counts_2"))
    close = (
        (F.col("fp") < F.col("fp_2"))
        & (manhattan(F.col("counts"), F.col("counts_2")) <= MOST_BITS)
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_2"))) <= MOST_BITS)
        & (F.floor(F.col("x.grid") / per_first) == first_grid(F.col("counts"), F.col("counts_2")))
    )
    return small.alias("x").join(
        other.alias("y").hint("merge"),
        (F.col("x.grid") == F.col("y.grid")) & (F.col("x.cell") == F.col("y.cell")) & close,
    ).select(F.col("fp").alias("a"), F.col("fp_2").alias("b"))


def block_chains(large: DataFrame) -> DataFrame:
    """(a, b): chains that join what the links inside large cells join, found block by block."""
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), n_blocks).cast("int")
    units = large.withColumn("own", own).select("fp", "grid", "cell", "own", F.explode(
        F.sequence(F.lit(0), n_blocks - 1)).alias("other")).select(
        "fp", "grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    parts = units.repartition(F.col("grid"), F.col("cell"), F.col("i"), F.col("j"))
    return parts.sortWithinPartitions("grid", "cell", "i", "j").mapInArrow(chained_links, "a long, b long")


def near_links(points: DataFrame) -> DataFrame:
    """(a, b): pairs of fingerprints that link, enough of them to join all that links join.

    Cells of up to BLOCK points give every pair at most 4 bits apart; larger ones are dealt to finer
    grids, and on the last level, where 25 or more of the 32 segments agree, into blocks whose pairs
    give chains. The chains grow with the points; the rows shuffled to pairs of blocks (n * n / BLOCK)
    and the comparisons (n * n) grow with the square of a cell of that last level only.
    """
    found, placed = [], cells(points)
    levels = grids()
    for level, masks in enumerate(levels):
        sizes = placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = written(placed.join(sizes.hint("merge"), ["grid", "cell"]), "simhash-cells")
        found.append(cell_pairs(shared.filter(F.col("n") <= BLOCK).drop("n"), len(masks) // len(levels[0])))
        large = shared.filter(F.col("n") > BLOCK)
        if level == len(levels) - 1:
            found.append(block_chains(large))
        elif large.isEmpty():
            break
        else:
            placed = finer_cells(large, level + 1)
    return reduce(DataFrame.unionByName, found).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node that a link names.

    Rounds of two steps: each node takes the least label of its neighbours, then the label of its
    label. A round is written to the shared folder, and the rounds end when no label changes; long
    chains take a number of rounds that is logarithmic in their length for most orders of labels.
    """
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
                         .select(F.col("a").alias("node"), "root"), "labels")
    while True:
        seen = both.join(labels.hint("merge").withColumnRenamed("node", "b"), "b")
        least = seen.groupBy("a").agg(F.min("root").alias("near"))
        # The label that a node hands to its own label, so that stars hook onto each other.
        step = labels.join(least.withColumnRenamed("a", "node"), "node").select(
            "node", "root", F.least("root", "near").alias("low"))
        step = materialise(step, "labels-step")
        hooks = step.filter("low < root").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        hooked = step.join(hooks, "node", "left").select(
            "node", "root", F.least("low", F.coalesce("hook", "low")).alias("low"))
        hooked = materialise(hooked, "labels-hooked")
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("far"))
        after = materialise(hooked.join(jump.hint("merge"), "low").select(
            "node", F.least("low", "far").alias("new"), "root"), "labels-next")
        if after.filter("new <> root").isEmpty():
            return after.select("node", F.col("new").alias("root"))
        labels = after.select("node", F.col("new").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
) -> DataFrame:
    """(_id, fp, component): one row per row of ``docs``; component is the least id reachable.

    Equal fingerprints are one point, so copies cost nothing in the search. Texts without words (null,
    empty, blank) have fingerprint zero and link like any other. A null id gets a component of its
    own only if no other id shares its fingerprint's component; nulls never become the least id.
    Rows of one id stay one row each. An empty table gives an empty table.
    """
    prints = written(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("_id").alias("least"))
    found = components(near_links(points.select("fp")))
    rooted = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_point = rooted.join(named.hint("merge"), "root").select("fp", "component")
    return prints.join(by_point.hint("merge"), "fp").select("_id", "fp", "component")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(docs: DataFrame) -> DataFrame:
    done = near_duplicates(docs)
    return done.select(F.col("_id").alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the least id of each component, with all its columns; null ids stay.

    Rows that repeat an id all stay or all go. Other columns may have any names.
    """
    known = F.col(f"`{id_col}`").isNotNull()
    kept = near_duplicates(docs.filter(known), id_col, text_col).filter("_id = component").select(
        F.col("_id").alias(id_col)).distinct()
    chosen = docs.join(kept.hint("shuffle_hash"), id_col, "left_semi")
    return chosen.unionByName(docs.filter(~known)).select(*[F.col(f"`{c}`") for c in docs.columns])
