"""Fuzzy line deduplication.

Lines are normalised to their letters and digits in lower case; each letter of a script without spaces is a word. Lines of the same words form a class. Two lines are
similar when the edit distance of their word sequences is at most a share of the longer one's words; nothing else
decides. Candidates share a key:

* lines of fewer than ``SHORT`` words are keyed by all their runs of one length. Edits cut what two lines have in common into few runs, so one run has
  at least a known number of words: this finds every similar pair;
* longer lines are keyed by the ``PICKED`` least hashes of their runs of ``PICKED_RUN`` words, those with several frequent words last. Of the runs of two lines of
  similarity 0.8 a third is common, so that all of their least ones differ has a chance of 0.66 ** 12 < 1%, and of less than
  1e-6 at similarity 0.95.

Parity sketches, whose bits cannot differ more often than the words do, part most other pairs before anything is compared. Verified links
form groups, and the first line of each group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import BROADCAST_IDS, here, release, semi_by_id, short_batches, written
from .links import PACKED, Packer, both_ends, buckets_for, candidates, linked

U = np.uint64
#: Words in a key's run at most (longer runs would only repeat what their own runs of three words find); class ids that a task remembers, so as to
#: key each class about once.
LONGEST = 3
#: Words from which on lines are keyed by a choice of their runs; runs chosen of a line, and their words.
SHORT = 20
PICKED = 12
PICKED_RUN = 3
#: Lines whose picked runs are sorted at a time.
PLACES = 1 << 18
#: 64-bit words of the parity sketches.
WIDTH = 8
SKETCH = [f"s{i}" for i in range(WIDTH)]
#: Share of all words from which on a word is frequent (so there are at most ``FREQUENT`` such words).
FREQUENT = 500
SEEN = 500_000
#: Bits a wanted class of the filter that tasks carry, bits of it at most (32 MB; with more classes it only lets more others pass), and bits of one part.
FILTER_BITS = 32
FILTER_MOST = 1 << 28
FILTER_PART = 1 << 20
#: Documents with dropped lines that are broadcast at most (with five lines each); more are joined by a shuffle.
BROADCAST_DROPS = 200_000


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity sketches of ``64 * WIDTH`` bits, a row of 64-bit words for each row of word hashes: every word flips one bit; a row without words gets 0."""
    rows, bits = len(offsets) - 1, 64 * WIDTH
    at = tk.rows_of(offsets) * bits + (hashes >> U(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(at, minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U).reshape(rows, WIDTH)


def marks_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each row: 120 bits of its sketch folded, and the number of its words up to 255."""
    wide = sketches(hashes, offsets)
    out = np.stack([np.bitwise_xor.reduce(wide[:, k::2], axis=1) for k in (0, 1)], axis=1)
    out[:, 0] = out[:, 0] & ~U(255) | np.minimum(np.diff(offsets), 255).astype(U)
    return out


def allowed(n: np.ndarray, similarity: float) -> np.ndarray:
    """The greatest edit distance of similar lines of which the longer one has ``n`` words."""
    return np.floor((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def run_table(size: int, similarity: float) -> np.ndarray:
    """Whether lines of n < ``size`` words are keyed by runs of q words, at [n, q].

    With d edits and n words in the longer line at least n - d words stay, in at most d + 1 runs.
    """
    n = np.arange(int(size / similarity) + 2)
    d = allowed(n, similarity)
    run = np.minimum(-(-(n - d) // (d + 1)), LONGEST)
    last = np.minimum(np.floor(n[:size] / similarity + 1e-9).astype(np.int64), len(n) - 1)
    out = np.zeros((size, LONGEST + 1), bool)
    for q in range(1, LONGEST + 1):
        before = np.concatenate([[0], np.cumsum((run == q) & (d > 0))])
        out[:, q] = before[last + 1] > before[:size]
    return out


def all_runs(hashes: np.ndarray, q: int, use: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``q`` words that begin at the places ``use``."""
    with np.errstate(over="ignore"):
        keys = np.full(len(use), q, U)
        for j in range(q):
            keys = tk.mix(keys + hashes[use + j])
    return keys


def run_keys(hashes: np.ndarray, offsets: np.ndarray, similarity: float, frequent: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of the lines.

    Lines of fewer than ``SHORT`` words get the hashes of all runs of the lengths in ``table`` (of ``run_table``): similar ones that are not equal
    share one. Lines of ``similarity * SHORT`` words or more get the ``PICKED`` least hashes of their runs of ``PICKED_RUN``
    words; runs with several ``frequent`` words (sorted) come last.
    """
    counts, row = np.diff(offsets), tk.rows_of(offsets)
    for q in range(1, LONGEST + 1):
        n = max(len(hashes) - q + 1, 0)
        use = np.flatnonzero((row[:n] == row[len(row) - n :]) & (counts[row[:n]] < SHORT))
        use = use[table[counts[row[use]], q]]
        yield row[use], all_runs(hashes, q, use)
    n = max(len(hashes) - PICKED_RUN + 1, 0)
    use = np.flatnonzero((row[:n] == row[len(row) - n :]) & (counts[row[:n]] >= similarity * SHORT - 1e-9))
    if not len(use):
        return
    common = np.zeros(len(hashes), np.int8)
    if len(frequent):
        common[frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes] = 1
    late = sum(common[use + j] for j in range(PICKED_RUN)) > 1
    keys, rows = all_runs(hashes, PICKED_RUN, use) >> U(1) | late.astype(U) << U(63), row[use]
    # A row's place and 46 bits of a key in one number: one array is sorted much faster than by two.
    new = np.concatenate([[True], rows[1:] != rows[:-1]])
    rows, place = rows[new], np.cumsum(new) - 1
    edges = np.searchsorted(place, np.arange(0, len(rows) + PLACES, PLACES))
    for base, (lo, hi) in enumerate(zip(edges, edges[1:])):
        both = np.sort((place[lo:hi] - base * PLACES).astype(U) << U(46) | keys[lo:hi] >> U(18))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        own = (both >> U(46)).astype(np.int64)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        least = np.arange(len(own)) - starts[own] < PICKED
        # Least hashes have few high bits; mixed again they choose buckets evenly.
        yield rows[own[least] + base * PLACES], tk.mix(both[least] & U((1 << 46) - 1))


def line_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines (parted by line feeds) of the rows, and each line's row."""
    feeds = np.flatnonzero(data[at[0] : at[-1]] == 10) + at[0] + 1
    per_row = np.diff(np.searchsorted(feeds, at, "right")) + 1
    bounds = np.sort(np.concatenate([at, feeds]), kind="stable")
    return bounds, np.repeat(np.arange(len(at) - 1), per_row)


def _lines(min_words: int):
    """The lines, and rows with a null id for the words that are frequent in a chunk: their hash as class_id, their number below zero as n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tk.bytes_of(batch.column(1))
            for lo, hi in tk.chunks(at):
                bounds, row = line_bounds(data, at[lo : hi + 1])
                hashes, offsets = tk.words(data, bounds, tk.LINES)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                use = np.diff(offsets) >= min_words
                top = (hashes >> U(48)).astype(np.int64)
                words, counts = np.unique(hashes[(np.bincount(top, minlength=1 << 16) * 2 * FREQUENT >= len(hashes))[top]], return_counts=True)
                often = counts * 2 * FREQUENT >= len(hashes)
                none, extra = pa.nulls(int(often.sum()), pa.int64()), np.zeros(int(often.sum()), np.int64)
                columns = [
                    (batch.column(0).slice(lo, hi - lo).take(pa.array(row[use])), none),
                    (pa.array(number[use].astype(np.int32)), pa.array(extra.astype(np.int32))),
                    (pa.array(tk.sequences(hashes, offsets)[use].view(np.int64)), pa.array(words[often].view(np.int64))),
                    (pa.array(np.diff(offsets)[use]), pa.array(-counts[often].astype(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["doc_id", "line_no", "class_id", "n_words"])

    return run


def _fresh(ids: np.ndarray, use: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows to ``use`` are the first of their class, here and among those ``seen``; these are added up to ``SEEN``."""
    first = np.unique(ids, return_index=True)[1]
    first = first[use[first]]
    new = [i for i, x in zip(first.tolist(), ids[first].tolist()) if x not in seen]
    if len(seen) < SEEN:
        seen.update(ids[new].tolist())
    out = np.zeros(len(ids), bool)
    out[new] = True
    return out


def _filter_part(bits: int):
    """One part of a filter of ``2 ** bits`` bits: those that the ids set."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = np.zeros(min(FILTER_PART, 1 << bits), bool)
        part[(table["id"].to_numpy().view(U) >> U(64 - bits)).astype(np.int64) % len(part)] = True
        return pa.table([pa.array([key[0].as_py()]), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["part", "set"])

    return run


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits that tell which of ``2 ** n`` ranges hold some of ``ids(id)``, 64-bit hashes: other ids are passed by seldom, none of these is lost."""
    bits = min(max(ids.count() * FILTER_BITS, 1 << 10), FILTER_MOST).bit_length() - 1
    part = F.expr(f"shiftrightunsigned(id, {64 - bits}) div {FILTER_PART}")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in ids.groupBy(part.alias("part")).applyInArrow(_filter_part(bits), "part long, set binary").collect():
        out[r["part"] * FILTER_PART // 8 :][: len(r["set"])] = np.frombuffer(r["set"], np.uint8)
    return out


def _line_words(wanted: np.ndarray):
    """Of the lines whose class passes the filter, about once a task: number of words, sketch, and the words as 32 bits of their hashes."""
    shift = U(64 - (len(wanted) * 8).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, at = tk.bytes_of(batch.column(0))
            for lo, hi in tk.chunks(at):
                bounds, _ = line_bounds(data, at[lo : hi + 1])
                hashes, offsets = tk.words(data, bounds, tk.LINES)
                ids = tk.sequences(hashes, offsets)
                place = (ids >> shift).astype(np.int64)
                use = np.flatnonzero(_fresh(ids.view(np.int64), wanted[place >> 3] << (place & 7).astype(np.uint8) & 128 > 0, seen))
                words = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((hashes >> U(32)).astype(np.uint32).view(np.int32))).take(pa.array(use))
                sketch = [pa.array(x.copy().view(np.int64)) for x in sketches(hashes, offsets)[use].T]
                yield pa.RecordBatch.from_arrays([pa.array(ids[use].view(np.int64)), pa.array(np.diff(offsets)[use]), *sketch, words], names=["id", "size", *SKETCH, "value"])

    return run


def _keyed(min_words: int, similarity: float, buckets: int, frequent: np.ndarray):
    """Packed (key, class) pairs of the classes in a text column, marked with 120 bits of the sketch and the number of words up to 255."""
    table = run_table(SHORT, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(buckets), set[int]()
        for batch in batches:
            data, at = tk.bytes_of(batch.column(0))
            for lo, hi in tk.chunks(at):
                bounds, _ = line_bounds(data, at[lo : hi + 1])
                hashes, offsets = tk.words(data, bounds, tk.LINES)
                counts, ids = np.diff(offsets), tk.sequences(hashes, offsets).view(np.int64)
                fresh = _fresh(ids, counts >= min_words, seen)
                marks = marks_of(hashes, offsets)
                for row, keys in run_keys(hashes, offsets, similarity, frequent, table):
                    use = fresh[row]
                    yield from packer.add(keys[use], ids[row[use]], marks[row[use]])
        yield from packer.flush()

    return run


def _marks_near(similarity: float):
    """A test on marks that all similar classes pass; lines of 255 words or more pass with any other."""
    table = allowed(np.arange(256), similarity)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = (a[:, 0] & U(255)).astype(np.int64), (b[:, 0] & U(255)).astype(np.int64)
        longer, most = np.maximum(x, y), table[np.maximum(x, y)]
        differ = np.bitwise_count((a[:, 0] ^ b[:, 0]) >> U(8)).astype(np.int64) + np.bitwise_count(a[:, 1] ^ b[:, 1])
        return (longer == 255) | (differ <= 2 * most - np.abs(x - y))

    return near


def edit_distance(a: np.ndarray, b: np.ndarray, most: float = np.inf) -> int:
    """Levenshtein distance of two sequences, or some lower bound above ``most``: common ends are cut off, bit vectors do the rest (Myers 1999, Hyyro 2003)."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return len(a) + len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down, rest = mask, 0, len(b)
    for x in b:
        equal = where.get(x, 0)
        zero = (((equal & up) + up) ^ up) | equal | down
        right, left = down | (mask & ~(zero | up)), up & zero
        distance += bool(right & top) - bool(left & top)
        rest -= 1
        if distance - rest > most:
            return distance - rest
        right, left = (right << 1 | 1) & mask, (left << 1) & mask
        up, down = left | (mask & ~(zero | right)), right & zero
    return distance


def shortest(min_words: int, similarity: float) -> int:
    """Words of the shortest line that can be similar to one of ``min_words`` words."""
    return max(1, int(np.ceil(similarity * min_words - 1e-9)))


def _similar(least: float, min_words: int):
    """Pairs within the edit similarity, of which one line at least has ``min_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for c in (2, 3):
                sizes = pc.list_value_length(batch.column(c)).to_numpy()
                ends.append((batch.column(c).flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), sizes))
            (x, x_at, nx), (y, y_at, ny) = ends
            most = allowed(np.maximum(nx, ny), least)
            keep = (np.abs(nx - ny) <= most) & (np.maximum(nx, ny) >= min_words)
            for i in np.flatnonzero(keep):
                keep[i] = edit_distance(x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]], most[i]) <= most[i]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def fuzzy_line_groups(docs: DataFrame, min_words: int, similarity: float, short_copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines(doc_id, line_no, class_id, n_words), groups(class_id, group_id)) of ``docs(doc_id, text)``; classes without links have no group row.

    Lines that are too short to be similar to one of ``min_words`` words get no links and are left out, unless ``short_copies``.
    """
    least = shortest(min_words, similarity)
    lines = written(docs.mapInArrow(_lines(1 if short_copies else least), "doc_id long, line_no int, class_id long, n_words long"), "lines")
    keyed = F.when(F.col("n_words") >= least, F.least("n_words", F.lit(SHORT)))
    total, n_keys = lines.where("doc_id is not null").agg(F.sum("n_words"), F.sum(keyed)).first()
    often = lines.where("doc_id is null").groupBy("class_id").agg(F.sum("n_words").alias("n")).where(-F.col("n") * FREQUENT >= (total or 0)).select("class_id").collect()
    frequent = np.sort(np.array([r[0] for r in often], np.int64).view(U))
    lines = lines.where("doc_id is not null")
    buckets = buckets_for(docs.sparkSession, n_keys or 0)
    packed = docs.select("text").mapInArrow(_keyed(least, similarity, buckets, frequent), PACKED)
    found = written(candidates(packed, buckets, _marks_near(similarity)), "found")
    wanted = written(found.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct(), "wanted")
    schema = f"id long, size long, {', '.join(f'{c} long' for c in SKETCH)}, value array<int>"
    values = written(semi_by_id(docs.select("text").mapInArrow(_line_words(id_filter(wanted)), schema), wanted, "id").dropDuplicates(["id"]), "values")

    def near(x: str, y: str) -> Column:
        most = f"floor({1 - similarity!r}D * greatest({x}.size, {y}.size) + 1e-9D)"
        apart = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in SKETCH)
        # One side has at least half of the differing words and of the difference in length; each costs an edit.
        return F.expr(f"{apart} <= 2 * {most} - abs({x}.size - {y}.size)")

    def verify(pairs: DataFrame) -> DataFrame:
        return both_ends(pairs, values.select("id", "value")).mapInArrow(_similar(similarity, min_words), "a long, b long")

    components = linked(found, values.drop("value"), near, verify, similarity)
    return lines, components.select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))


def dedup_lines(docs: DataFrame, min_words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", short_copies: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and columns n_lines and n_removed (long) added or replaced.

    Of each group of equal or similar lines the one with the least (id, line number) stays. Lines of fewer than
    ``min_words`` normalised words are similar to longer ones only, of ``min_words`` words at least; where they are not they are left alone, or with ``short_copies`` their exact
    copies (equal words) are taken out; lines without a word stay. ``n_chars``, if there is such a column,
    is brought up to date. A null text stays null with no lines; an empty text is one line and stays. Rows
    with a null id are returned as they are. Rows that share an id are one document: their equal line numbers count as
    one occurrence. Lines and texts of any length are read whole. Every other column is returned as it came.
    """
    short_batches(docs.sparkSession)
    before = here()
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    lines, groups = fuzzy_line_groups(plain, min_words, similarity, short_copies)
    few = groups.count() <= BROADCAST_IDS
    named = lines.join(F.broadcast(groups) if few else groups, "class_id", "left")
    if not short_copies:
        named = named.where((F.col("n_words") >= min_words) | F.col("group_id").isNotNull())
    named = named.select("doc_id", "line_no", F.coalesce("group_id", "class_id").alias("g"))
    keep = named.groupBy("g").agg(F.min(F.struct("doc_id", "line_no")).alias("keep"), F.count("*").alias("n")).where("n > 1").select("g", "keep")
    out = named.join(keep, "g").where("struct(doc_id, line_no) <> keep")
    drops = written(out.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__drop")), "drops")
    release(before, drops)
    size = drops.agg(F.count("*"), F.sum(F.size("__drop"))).first()
    few = size[0] <= BROADCAST_DROPS and (size[1] or 0) <= 5 * BROADCAST_DROPS
    joined = docs.join(F.broadcast(drops) if few else drops, F.col(id_col).cast("long") == F.col("__id"), "left")
    text = F.col(text_col).cast("string")
    parts = F.split(text, "\n", -1)
    left = F.concat_ws("\n", F.filter(parts, lambda line, i: ~F.array_contains("__drop", i)))
    joined = joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
    joined = joined.withColumn("n_removed", F.coalesce(F.array_size("__drop"), F.lit(0)).cast("long"))
    joined = joined.withColumn(text_col, F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(left))
    if "n_chars" in docs.columns and text_col != "n_chars":
        joined = joined.withColumn("n_chars", F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return joined.drop("__id", "__drop")
