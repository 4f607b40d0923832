"""N-gram Jaccard join by parity sketches.

Each document's set of k-word shingles is hashed into a bit sketch: every shingle flips one bit, so the Hamming distance
of two sketches is at most the size of the sets' symmetric difference. Two sets link when
``100 * intersection >= percent * union``; then their difference is at most ``(100 - percent) / (100 + percent)`` of the sum
of their sizes. Sizes fall into bands such that linked sets lie in one band or in neighbouring ones. For each band the
sketch has one block more than the largest difference possible there, so that linked sets agree in at least one whole block
(pigeonhole). Equal blocks make the candidates; a fixed-size sketch of the whole set sorts out most, one that is as wide as the set is large
sorts out those of long texts, which a fixed size tells little about, and the exact sets decide. Only sets that are left then are made.

An empty block says nothing, and all documents of a band with the same empty block would be candidates; so empty blocks give no keys.
Linked sets whose equal blocks are all empty would be lost: bands where the chance of that is above ``MISS`` cut
their sets several times, by independent hash functions, so that it falls below ``MISS`` over the hash functions, less than that of a false match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import BROADCAST_IDS, here, release, semi_by_id, short_batches, written
from .line_dedup import id_filter
from .links import THIN, ThinPacker, both_ends, buckets_for, linked, thin_candidates

U = np.uint64


#: Chance at most that a link is lost because all equal blocks are empty; blocks from which on it is below 1e-12 for one hash function.
MISS = 1e-6
MANY = 64


def chance_of_empty(blocks: int, common: int) -> float:
    """The chance that all of the blocks without any of ``blocks - 1`` differing items hold none of ``common`` items either."""
    free = np.zeros(blocks + 1)
    free[blocks] = 1.0
    for _ in range(blocks - 1):
        u = np.arange(blocks + 1)
        free = free * (1 - u / blocks) + np.append((free * u / blocks)[1:], 0.0)
    return float((free * (1 - np.arange(blocks + 1) / blocks) ** common).sum())


class Bands:
    """Bounds of the size bands, and of each band (with its upper neighbour) the number of sketch blocks and of hash functions."""

    def __init__(self, percent: int) -> None:
        self.percent, self.low, self.blocks, self.cuts = percent, [1], [], []

    def upto(self, size: int) -> None:
        while self.low[-1] <= size or len(self.blocks) < len(self.low) - 1:
            band = len(self.blocks)
            if len(self.low) > band + 1:
                a = self.low[band + 1] - 1
                blocks = (a + 100 * a // self.percent) * (100 - self.percent) // (100 + self.percent) + 1
                common = -(-2 * self.low[band] * self.percent // (100 + self.percent))
                self.blocks.append(blocks)
                # One block means equal sets, which are one class already.
                self.cuts.append(0 if blocks == 1 else 1 if blocks >= MANY else int(np.ceil(np.log(MISS) / np.log(chance_of_empty(blocks, common)))))
            else:
                self.low.append(100 * self.low[-1] // self.percent + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.upto(int(sizes.max(initial=1)) + 1)
        return np.searchsorted(np.array(self.low), sizes, "right") - 1


#: Bits in a block; only the odd ones are kept, as the XOR of their numbers' hashes.
WIDE = 1 << 32
#: 64-bit words of the fixed-size parity sketch that sorts out candidates before wide sketches and sets are compared.
WIDTH = 8


def fixed_sketches(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity sketches of ``64 * WIDTH`` bits, a row of words for each set."""
    rows, bits = len(offsets) - 1, 64 * WIDTH
    at = tk.rows_of(offsets) * bits + ((sets >> U(20)) % U(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U).reshape(rows, WIDTH)


def wide_sketches(sets: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Parity sketches of at least as many bits as a set has items, a power of two, as bytes; null where the fixed-size one has as many.

    Halves of a sketch folded on each other make the one of half as many bits, and so on down to the fixed-size one.
    """
    sizes, row = np.diff(offsets), tk.rows_of(offsets)
    bits = np.maximum(64 * WIDTH, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    bits[bits == 64 * WIDTH] = 0
    begin = np.concatenate([[0], np.cumsum(bits)])
    use = bits[row] > 0
    at = begin[row[use]] + ((sets[use] >> U(20)) & (bits[row[use]] - 1).astype(U)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8))
    return pa.array([odd[lo:hi].tobytes() if hi > lo else None for lo, hi in zip(begin // 8, begin[1:] // 8)], pa.binary())


def class_ids(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id for each set; equal sets share it."""
    return tk.sequences(sets, offsets, 43)


def _band_blocks(sizes: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set its own band and the one below, each with the numbers of blocks and of hash functions there (0 where there is no such band)."""
    own = bands.of(sizes)
    blocks, cuts = np.array(bands.blocks), np.array(bands.cuts)
    for band in (own, own - 1):
        there = (sizes > 0) & (band >= 0)
        yield band, np.where(there, blocks[np.maximum(band, 0)], 0), np.where(there, cuts[np.maximum(band, 0)], 0)


def key_counts(offsets: np.ndarray, bands: Bands) -> np.ndarray:
    """At most how many keys each set has."""
    sizes = np.diff(offsets)
    return sum(np.minimum(blocks, sizes) * cuts for _, blocks, cuts in _band_blocks(sizes, bands))


def sketch_keys(sets: np.ndarray, offsets: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, the set of each): hashes of (band, hash function, block number, block bits) of the blocks that hold items, for the band of the set and the one below."""
    sizes, row = np.diff(offsets), tk.rows_of(offsets)
    for band, blocks, cuts in _band_blocks(sizes, bands):
        for cut in range(int(cuts.max(initial=0))):
            k = np.where(cuts > cut, blocks, 0)
            begin = np.concatenate([[0], np.cumsum(k)])
            use = k[row] > 0
            h, r = sets[use], row[use]
            if cut:
                h = tk.mix(h + U(cut))
            block = begin[r] + ((h >> U(32)) % k[r].astype(U)).astype(np.int64)
            sketch = np.zeros(int(begin[-1]), U)
            np.bitwise_xor.at(sketch, block, tk.mix((h & U(WIDE - 1)) + U(1)))
            full = np.flatnonzero(np.bincount(block, minlength=len(sketch)) > 0)
            of = np.repeat(np.arange(len(sizes)), k)[full]
            with np.errstate(over="ignore"):
                name = tk.mix((band[of].astype(U) * U(64) + U(cut)) * U(0x9E3779B97F4A7C15) + (full - begin[of]).astype(U) + U(1))
            yield tk.mix(sketch[full] ^ name), of


def _sketched(k: int, percent: int):
    """Document rows: id, size and class of the set, number of keys, fixed-size and wide sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            data, at = tk.bytes_of(batch.column(1))
            for lo, hi in tk.chunks(at):
                sets, offsets = tk.shingle_sets(*tk.words(data, at[lo : hi + 1], tk.SPACED), k)
                columns = [np.diff(offsets), class_ids(sets, offsets).view(np.int64), key_counts(offsets, bands), *(x.copy().view(np.int64) for x in fixed_sketches(sets, offsets).T)]
                names = ["doc_id", "n_shingles", "class_id", "n_keys", *(f"s{i}" for i in range(WIDTH)), "wide"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, columns), wide_sketches(sets, offsets)], names=names)

    return run


def _keyed(k: int, percent: int, buckets: int):
    """Packed (block key, class) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, packer = Bands(percent), ThinPacker(buckets)
        for batch in batches:
            data, at = tk.bytes_of(batch.column(0))
            for lo, hi in tk.chunks(at):
                sets, offsets = tk.shingle_sets(*tk.words(data, at[lo : hi + 1], tk.SPACED), k)
                ids = class_ids(sets, offsets).view(np.int64)
                for keys, owner in sketch_keys(sets, offsets, bands):
                    yield from packer.add(keys, ids[owner])
        yield from packer.flush()

    return run


def _wide_near(percent: int):
    """Pairs whose wide sketches, each folded to the bits of the other, differ no more than those of linked sets; pairs without two wide sketches pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [(c.field("size").to_numpy(), c.field("wide")) for c in (batch.column(2), batch.column(3))]
            keep = np.ones(len(batch), bool)
            for i in np.flatnonzero(ends[0][1].is_valid().to_numpy(False) & ends[1][1].is_valid().to_numpy(False)):
                x, y = (np.frombuffer(wide[i].as_buffer(), U) for _, wide in ends)
                x, y = ((np.bitwise_xor.reduce(z.reshape(-1, min(len(x), len(y))), axis=0)) for z in (x, y))
                keep[i] = np.bitwise_count(x ^ y).sum(dtype=np.int64) <= (ends[0][0][i] + ends[1][0][i]) * (100 - percent) // (100 + percent)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(k: int, wanted: np.ndarray):
    """Classes and sets of the texts whose id's hash passes the filter; the others are not read for words."""
    shift = U(64 - (len(wanted) * 8).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (batch.column(0).to_numpy().view(U) >> shift).astype(np.int64)
            texts = batch.column(1).filter(pa.array(wanted[place >> 3] << (place & 7).astype(np.uint8) & 128 > 0, pa.bool_()))
            data, at = tk.bytes_of(texts) if len(texts) else (None, [0])
            for lo, hi in tk.chunks(at):
                sets, offsets = tk.shingle_sets(*tk.words(data, at[lo : hi + 1], tk.SPACED), k)
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(sets, offsets).view(np.int64)), tk.listed(sets, offsets)], names=["id", "value"])

    return run


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id.

    Words are runs of anything but white space, A-Z lower-cased. A text of fewer than ``k`` words has its whole sequence as
    its one shingle. ``component_id`` is the smallest id that links reach; ``class_id`` names the exact set.
    Null and blank texts have no shingles, no class
    and no links: each is its own component. A null id is carried along and never becomes a component id unless the
    whole component has none. Rows with a repeated id count as separate texts of one document id. Other columns
    of ``docs`` are ignored.
    """
    short_batches(docs.sparkSession)
    before = here()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id long, n_shingles long, class_id long, n_keys long, {', '.join(f's{i} long' for i in range(WIDTH))}, wide binary"
    sketched = written(source.mapInArrow(_sketched(k, percent), schema), "sketches")
    full = sketched.where("n_shingles > 0")
    buckets = buckets_for(docs.sparkSession, sketched.agg(F.sum("n_keys")).first()[0] or 0)
    found = written(thin_candidates(source.select("text").mapInArrow(_keyed(k, percent, buckets), THIN), buckets), "found")
    wanted = written(found.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct(), "wanted")
    sketch = [f"s{i}" for i in range(WIDTH)]
    facts = semi_by_id(full.select(F.col("class_id").alias("id"), "doc_id", F.col("n_shingles").alias("size"), *sketch, "wide"), wanted, "id").groupBy("id")
    facts = written(facts.agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("size", *sketch, "wide"))), "facts")

    def near(x: str, y: str) -> Column:
        apart = " + ".join(f"bit_count({x}.s{i} ^ {y}.s{i})" for i in range(WIDTH))
        fits = f"100 * least({x}.size, {y}.size) >= {percent} * greatest({x}.size, {y}.size)"
        return F.expr(f"{fits} AND {apart} <= ({x}.size + {y}.size) * {100 - percent} div {100 + percent}")

    def verify(pairs: DataFrame) -> DataFrame:
        close = written(both_ends(pairs, facts.select("id", F.struct("size", "wide").alias("value"))).mapInArrow(_wide_near(percent), "a long, b long"), "near")
        ends = written(close.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
        if not ends.limit(1).count():
            return close
        # Texts are not moved: tasks pass those by that no wanted document can have.
        few = ends.count() <= BROADCAST_IDS
        held = facts.join(F.broadcast(ends) if few else ends, "id").select(F.xxhash64("doc_id").alias("id")).distinct()
        made = source.select(F.xxhash64("doc_id"), "text").mapInArrow(_sets(k, id_filter(held)), "id long, value array<long>")
        sets = written(semi_by_id(made, ends, "id"), "sets")
        both = F.size(F.array_intersect("value_a", "value_b"))
        fits = 100 * both >= percent * (F.size("value_a") + F.size("value_b") - both)
        return both_ends(close, sets).where(fits).select("a", "b")

    components = linked(found, facts.drop("doc_id", "wide"), near, verify, percent / 100)
    release(before, sketched, components)
    classes = components.select(F.col("node").alias("class_id"), "component")
    named = sketched.select("doc_id", "n_shingles", "class_id").join(F.broadcast(classes) if classes.count() <= BROADCAST_IDS else classes, "class_id", "left")
    named = named.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "class_id")))
    least = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"),
    )
