"""Mixing sources to target weights with DataFrame functions only.

The words of each source form one stream, packed into blocks of ``BLOCK`` words. A mix of as many words as there are is
drawn in slots of one block. A seeded hash of each slot orders the slots of all sources, and runs of this order are the
output shards, so that a shard's source counts are a multinomial draw conditioned on the totals: whatever the shards get,
each source gets its target to within half a block. An affine permutation of each source's block numbers, with another offset in
each round, says which block a slot holds. Blocks are joined by number with their words: that is the mix, and what
it takes of each document is counted from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

#: Words in a block, slots in an output shard, parts that a source's documents and the slots are numbered in, slots made at a time.
BLOCK = 64
SHARD = 1024
PARTS = 4096
STRIDE = 1024
#: Two primes that multiply slot numbers; one of them at least is coprime to any smaller count.
PRIMES = (15485863, 15485867)
WORDS = r"'[^\\x20\\x09-\\x0D]+'"


def _coprime(n: str) -> str:
    return f"CASE WHEN {n} % {PRIMES[0]} <> 0 THEN {PRIMES[0]}L ELSE {PRIMES[1]}L END"


def _seeded(what: str) -> str:
    """A pseudorandom number of 28 bits for a SQL string."""
    return f"cast(conv(substr(md5({what}), 1, 7), 16, 10) AS bigint)"


def source_targets(sized: DataFrame, weights: tuple[float, ...], most: float, block: int) -> DataFrame:
    """For each source of ``sized(source, size)``: sid (its rank, null last), source_size, target, blocks, slots, first_slot.

    Weights repeat along the ranks. Targets share the total by weight but stop at ``most`` times the source's size; what is above
    goes to the others by weight. Sorted by the level at which each source is full, the first ones are full, and one level
    holds for the rest.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("sid", F.row_number().over(by_name).cast("long"))
    listed = "array({})".format(", ".join(f"{float(w)}D" for w in weights))
    sources = sources.withColumn("weight", F.expr(f"{listed}[cast((sid - 1) % {len(weights)} AS int)]"))
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.expr("cap / weight"))
    order = Window.orderBy("full_at", "sid")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sources = sources.withColumn("total", F.sum("source_size").over(everything))
    sources = sources.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    sources = sources.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    sources = sources.withColumn("target", F.expr("coalesce(CASE WHEN full_at <= level THEN cap ELSE level * weight END, cap)"))
    sources = sources.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    sources = sources.withColumn("slots", F.expr("CASE WHEN source_size > 0 THEN cast(floor(target / source_size * blocks + 0.5) AS bigint) ELSE 0L END"))
    by_rank = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("first_slot", F.coalesce(F.sum("slots").over(by_rank), F.lit(0)).cast("long")).withColumn("n_slots", F.sum("slots").over(everything).cast("long"))
    return sources.select("source", "sid", "source_size", "target", "blocks", "slots", "first_slot", "n_slots")


def mixture_slots(sources: DataFrame, shard: int = SHARD, seed: str = "mix") -> DataFrame:
    """(shard, place, sid, block): what each slot of the mix holds; slots are numbered in the order of a seeded hash."""
    starts = sources.where("slots > 0").select("sid", "blocks", "slots", F.explode(F.expr(f"sequence(0L, slots - 1, {STRIDE}L)")).alias("from"))
    starts = starts.repartition("sid", "from")
    slots = starts.select("*", F.explode(F.expr(f"sequence(from, least(from + {STRIDE - 1}, slots - 1))")).alias("j"))
    offset = _seeded(f"concat('{seed}/', sid, '/', j div blocks)")
    block = f"(({_coprime('blocks')}) * (j % blocks) + {offset}) % blocks"
    drawn = written(slots.select("sid", "j", F.expr(block).alias("block"), F.xxhash64(F.lit(seed), "sid", "j").alias("h")), "drawn").withColumn("part", F.expr(f"pmod(h, {PARTS})"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    bases = drawn.groupBy("part").agg(F.count("*").alias("n")).select("part", base)
    inside = Window.partitionBy("part").orderBy("h", "sid", "j")
    slot = drawn.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(bases), "part").select("sid", "block", (F.col("base") + F.col("rank") - 1).alias("slot"))
    return slot.select(F.expr(f"slot div {shard}").alias("shard"), F.expr(f"slot % {shard}").alias("place"), "sid", "block")


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, sid, n): the drawn number of blocks of each source in each output shard."""
    return slots.groupBy("shard", "sid").agg(F.count("*").alias("n"))


def _placed(docs: DataFrame, weights: tuple[float, ...], most: float, block: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, placed, sources): the texts with their source's sid; the documents, without texts, with their place in the stream of
    their source (sid, part, tie, start); the sources. Rows of one id and source are told apart by ``copy``, in the order of their sizes."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = written(texts.select("doc_id", "source", F.expr(f"coalesce(regexp_count(text, {WORDS}), 0)").cast("long").alias("size")), "sized")
    sources = written(source_targets(sized.select("source", "size"), weights, most, block), "sources")
    few = sources.count() <= BROADCAST_IDS // 16
    known = F.broadcast(sources) if few else sources
    placed = sized.alias("d").join(known.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left").select("d.*", "s.sid", "s.source_size", "s.target").withColumn("part", F.expr(f"coalesce(pmod(doc_id, {PARTS}), 0)"))
    inside = Window.partitionBy("sid", "part").orderBy("doc_id", "size")
    ahead = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumns({"ahead": ahead, "tie": F.row_number().over(inside)})
    placed = written(placed.withColumn("copy", F.row_number().over(Window.partitionBy("sid", "part", "doc_id").orderBy("tie"))), "placed")
    parts = placed.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    base = F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("sid", "part", base.alias("base"))
    few = parts.count() <= BROADCAST_IDS // 2
    placed = placed.join(F.broadcast(parts) if few else parts, ["sid", "part"]).withColumn("start", F.col("base") + F.col("ahead")).drop("base", "ahead")
    texts = texts.alias("t").join(known.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.doc_id", "t.text", "s.sid")
    return texts, placed, sources


def _located(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """Texts with their place; only the texts of repeated ids are ordered, to be told apart."""
    again = written(placed.where("copy > 1").select("doc_id", "sid").distinct(), "again")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.sid") == F.col("y.sid"))
    n = again.count()
    if n:
        side = (F.broadcast(again) if n <= BROADCAST_IDS else again).alias("y")
        order = Window.partitionBy("doc_id", "sid").orderBy(F.expr(f"coalesce(regexp_count(text, {WORDS}), 0)"), "text")
        repeated = texts.alias("x").join(side, same, "left_semi").withColumn("copy", F.row_number().over(order))
        texts = texts.alias("x").join(side, same, "left_anti").withColumn("copy", F.lit(1)).unionByName(repeated)
    else:
        texts = texts.withColumn("copy", F.lit(1))
    spots = placed.where("size > 0").select("doc_id", "sid", "copy", "size", "part", "tie", "start")
    few = placed.count() <= BROADCAST_IDS
    spots = (F.broadcast(spots) if few else spots).alias("y")
    return texts.alias("x").join(spots, same & (F.col("x.copy") == F.col("y.copy"))).select("x.sid", "text", "size", "part", "tie", "start")


def _mixed(texts: DataFrame, placed: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(shard, place, source, sid, block, text, pieces): the mix; pieces(part, tie, n) say whose words a block holds."""
    first, last = f"greatest(start, b * {block})", f"least(start + size, (b + 1) * {block})"
    # The lambda over an array of one keeps a text's words from being parted again for every block.
    piece = f"b -> struct(b AS block, {first} AS at, {last} - {first} AS n, array_join(slice(w, cast({first} - start + 1 AS int), cast({last} - {first} AS int)), ' ') AS words)"
    pieces = f"transform(array(regexp_extract_all(text, {WORDS}, 0)), w -> transform(sequence(start div {block}, (start + size - 1) div {block}), {piece}))[0]"
    spans = _located(texts, placed).select("sid", "part", "tie", F.explode(F.expr(pieces)).alias("p")).select("sid", "p.block", "p.at", "part", "tie", "p.n", "p.words")
    blocks = spans.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("at", "part", "tie", "n", "words"))).alias("p"))
    text, pieces = F.expr("array_join(transform(p, x -> x.words), ' ')"), F.expr("transform(p, x -> struct(x.part, x.tie, x.n))")
    blocks = blocks.select("sid", "block", text.alias("text"), pieces.alias("pieces"))
    # Slots are made from a small table, which would make the planner take them for few.
    mix = blocks.join(mixture_slots(sources).hint("merge"), ["sid", "block"])
    return mix.join(sources.select("sid", "source"), "sid").select("shard", "place", "source", "sid", "block", "text", "pieces")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix, one row per slot: shard, place, source, block, text (the block's words); shards hold ``SHARD`` slots, the last one what is left."""
    return _mixed(*_placed(docs, weights, most, block, id_col, text_col, source_col), block).drop("sid", "pieces")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    The mix is made in the shared folder. ``taken`` counts the words of the document that it holds, repeats included; it is at most ``most`` times the size.
    Null and blank texts have size 0 and nothing is taken. A null source is a source of its own, ranked last. Null ids and repeated
    rows are documents like others; rows of one id and size take each other's place freely. Texts of any length are read whole. A source without words has target 0; sources that are full
    at the same level go in the order of their names. No documents give no rows. Other columns are
    ignored.
    """
    texts, placed, sources = _placed(docs, weights, most, block, id_col, text_col, source_col)
    mix = written(_mixed(texts, placed, sources, block), "mix")
    taken = mix.select("sid", F.explode("pieces").alias("p")).groupBy("sid", "p.part", "p.tie").agg(F.sum("p.n").alias("taken"))
    return placed.join(taken, ["sid", "part", "tie"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
