"""Benchmark decontamination with DataFrame functions only.

Texts and benchmark items become lower-case words of letters and digits. Windows of a document, as long as an item and beginning at any
word, are fingerprinted by the SimHash of their weighted shingles. Fingerprints are cut into ``RADIUS + 1`` blocks: two within Hamming
distance ``RADIUS`` agree in one block at least (pigeonhole), so an equi-join on (size, block, bits) finds them all. The exact
weighted Jaccard similarity of the shingles then decides.

Two bags of shingles of similarity s share at least s / (1 + s) of their shingles taken together. So a window in which fewer shingles than that
belong to items of its size, in whatever order and from whichever items, is similar to none, and is not fingerprinted; this loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, semi_by_id, written

#: Fixed values. With 64 bits, shingle sets of similarity 0.8 differ in 10 bits on average and hardly ever in more than 20.
RADIUS = 20
BITS = 64
LANE = 65535


def words(text: str) -> Column:
    """The words of a text column; none for null."""
    return F.coalesce(F.expr(rf"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+', 0)"), F.array().cast("array<string>"))


def shingles(column: str, k: int) -> Column:
    """Hashes of all ``k``-word shingles of an array of words, in order, repeats included."""
    parts = ", ".join(f"{column}[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size({column}) >= {k} THEN transform(sequence(0, size({column}) - {k}), i -> xxhash64({parts})) ELSE cast(array() AS array<bigint>) END")


def simhash(column: str) -> Column:
    """SimHash of an array of hashes, each counted as often as it occurs: bits are counted in four lanes of 16 bits, in runs of ``LANE`` hashes."""
    lanes = "transform(sequence(0, 15), j -> aggregate(run, 0L, (n, h) -> n + (shiftrightunsigned(h, j) & 281479271743489L)))"
    runs = f"transform(sequence(0, (size({column}) - 1) div {LANE}), r -> slice({column}, r * {LANE} + 1, {LANE}))"
    ones = "aggregate(counts, 0, (n, c) -> n + cast(shiftrightunsigned(c[b % 16], 16 * (b div 16)) & 65535L AS int))"
    bits = f"aggregate(sequence(0, {BITS - 1}), 0L, (fp, b) -> fp | CASE WHEN 2 * {ones} > size({column}) THEN shiftleft(1L, b) ELSE 0L END)"
    # The lambda over an array of one keeps the counts from being made again for every bit.
    return F.expr(f"CASE WHEN size({column}) > 0 THEN transform(array(transform({runs}, run -> {lanes})), counts -> {bits})[0] ELSE 0L END")


def blocks(fp: str) -> Column:
    """(number, bits) of the blocks of a fingerprint."""
    edge = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L").alias("bits")) for i, (a, b) in enumerate(zip(edge, edge[1:]))))


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of least over sum of greatest counts of the shingles of two arrays."""
    count = "size(filter({}, x -> x = h))"
    both = f"aggregate(array_distinct({a}), 0, (n, h) -> n + least({count.format(a)}, {count.format(b)}))"
    return F.expr(f"{both} / (size({a}) + size({b}) - {both})")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, hamming): the best window for each document and item it contains.

    Items of fewer than ``k`` words are one shingle of all their words; a document shorter than an item is one window. Null or wordless texts and items match nothing;
    rows with a null id cannot be named and give no rows; rows that share an id count as one document. Of windows with equal
    similarity the first is reported. Texts of any length are read whole. Other columns are ignored. Without items or documents the result is empty.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words(f"cast({item_text} AS string)").alias("w")).where("item_id is not null and size(w) > 0")
    items = items.withColumn("m", F.size("w"))
    lengths = sorted(r[0] for r in items.select(F.least("m", F.lit(k))).distinct().collect())
    if not lengths:
        lengths = [k]

    def own(column: str, size: str) -> Column:
        """The shingles of an array laid against items of ``size`` words."""
        out = shingles(column, lengths[-1])
        for n in lengths[:-1]:
            out = F.when(F.expr(f"least({size}, {k})") == n, shingles(column, n)).otherwise(out)
        return out

    items = written(items.withColumn("s", own("w", "m")).withColumn("fp", simhash("s")).drop("w"), "items")
    wanted = items.select("m", F.explode("s").alias("h")).groupBy("h", "m").agg(F.count("*").alias("n")).drop("n")
    few = wanted.count() <= BROADCAST_IDS
    tokens = source.select("doc_id", words("text").alias("w"))
    each = F.concat(*(F.transform(shingles("w", n), lambda h, i: F.struct(i.alias("p"), h.alias("h"))) for n in lengths))
    if len(lengths) == 1:
        at = tokens.select("doc_id", F.size("w").alias("n"), F.posexplode(shingles("w", lengths[0])).alias("p", "h"))
    else:
        at = tokens.select("doc_id", F.size("w").alias("n"), F.explode(each).alias("x")).select("doc_id", "n", "x.p", "x.h")
    hits = at.join(F.broadcast(wanted) if few else wanted, "h").groupBy("doc_id", "m").agg(F.sort_array(F.collect_set("p")).alias("at"), F.min("n").alias("n"))
    # Shingles of the item, of a window, and how many of the window's must belong to items.
    mine, laid = f"greatest(1, m - {k} + 1)", f"greatest(1, least(m, n) - {k} + 1)"
    hits = hits.withColumn("len", F.expr(laid)).withColumn("least", F.expr(f"cast(ceil({similarity!r}D / (1 + {similarity!r}D) * ({mine} + {laid}) - 1e-9D) AS int)")).where("size(at) >= least")
    begin = "greatest(0, at[i + least - 1] - len + 1, CASE WHEN i > 0 THEN at[i - 1] + 1 ELSE 0 END)"
    spans = f"filter(transform(sequence(0, size(at) - least), i -> struct({begin} AS a, at[i] AS b)), x -> x.a <= x.b)"
    starts = hits.select("doc_id", "m", F.explode(F.expr(spans)).alias("x")).select("doc_id", "m", F.explode(F.expr("sequence(x.a, x.b)")).alias("start"))
    starts = written(starts, "starts")
    held = semi_by_id(source, starts.select("doc_id").distinct(), "doc_id").select("doc_id", words("text").alias("w"))
    begin = F.expr("greatest(0, least(start, size(w) - m))")
    windows = starts.join(held, "doc_id").select("doc_id", "m", begin.alias("start"), F.slice("w", begin + 1, F.col("m")).alias("w"))
    windows = windows.withColumn("s", own("w", "m")).where("size(s) > 0").select("doc_id", "m", "start", F.size("w").alias("n_words"), "s")
    windows = written(windows.dropDuplicates(["doc_id", "m", "start", "s"]).withColumn("fp", simhash("s")), "windows")
    left = windows.select("doc_id", "start", "n_words", "m", "s", "fp", F.explode(blocks("fp")).alias("k")).select("*", "k.block", "k.bits").drop("k")
    right = items.select("item_id", "m", F.col("fp").alias("item_fp"), F.explode(blocks("fp")).alias("k")).select("*", "k.block", "k.bits").drop("k")
    few = right.count() <= BROADCAST_IDS
    # A pair may agree in several blocks; it is kept in the first of them only.
    first = F.expr("block = " + f"aggregate(sequence(0, {RADIUS}), -1, (f, i) -> CASE WHEN f >= 0 OR " + _block_of("fp") + " <> " + _block_of("item_fp") + " THEN f ELSE i END)")
    near = left.join(F.broadcast(right) if few else right, ["m", "block", "bits"]).withColumn("hamming", F.expr("bit_count(fp ^ item_fp)")).where(F.col("hamming") <= RADIUS).where(first)
    bags = items.select("item_id", F.col("m").alias("item_m"), F.col("s").alias("item_s"))
    few = (items.agg(F.sum(F.size("s"))).first()[0] or 0) <= BROADCAST_IDS
    met = near.join(F.broadcast(bags) if few else bags, (near["item_id"] == bags["item_id"]) & (near["m"] == bags["item_m"])).drop(bags["item_id"])
    found = met.withColumn("similarity", weighted_jaccard("s", "item_s")).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "n_words", "similarity", "hamming"), F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").alias("start_word"), "best.n_words", "best.similarity", "best.hamming")


def _block_of(fp: str) -> str:
    """SQL for block ``i`` of a fingerprint."""
    edge = f"(i * {BITS}) div {RADIUS + 1}"
    after = f"((i + 1) * {BITS}) div {RADIUS + 1}"
    return f"(shiftrightunsigned({fp}, cast({edge} AS int)) & (shiftleft(1L, cast({after} - {edge} AS int)) - 1L))"


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    bad = written(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("__bad")).distinct(), "bad")
    few = bad.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(bad) if few else bad, F.col(id_col).cast("long") == F.col("__bad"), "left_anti")
