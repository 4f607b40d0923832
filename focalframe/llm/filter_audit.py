"""How filters of a corpus overlap: what each removes in every order, alone and on average, with duplicates found by partition refinement.

Rows whose texts may be equal are found without moving texts: they are split by length in code points, then by the hashes of
successive blocks (each four times as long as the one before, so that a text of n code points takes log n rounds), and a row that is
alone in its class leaves after each round. The full texts of the classes that are left are compared by grouping, with partial
aggregation, so that a text with many copies is sent once by each task. Each row then has a mask of failed filters. Rows are
counted by part and mask first, and all orders are evaluated on these few counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

WORDS = r"'[^\\x20\\x09-\\x0D]+'"
#: Failure conditions on text, n_words, n_distinct and n_chars.
CONDITIONS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * regexp_count(text, '[A-Z]') > 5 * n_chars",
    "D": "text RLIKE '[#$%&*|]'",
}
#: The letter of the filter that removes repeated texts.
REPEATED = "E"
#: Code points in the first block; starts of blocks, which cover any string that Spark can hold.
BLOCK = 64
STARTS = [BLOCK * (4**k - 1) // 3 for k in range(14)]


def measured(docs: DataFrame, conditions: dict[str, str], id_col: str, text_col: str, part_col: str, hash_bits: int) -> DataFrame:
    """(id, part, text, fails, n_chars, blocks): letters of the failed conditions and hashes of the successive blocks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The lambda over an array of one keeps a text from being parted into words twice.
    counts = F.expr(f"transform(array(regexp_extract_all(text, {WORDS}, 0)), w -> struct(size(w) AS n, size(array_distinct(w)) AS d))[0]")
    rows = rows.withColumns({"n_chars": F.expr("char_length(text)"), "counts": counts}).withColumns({"n_words": F.col("counts.n"), "n_distinct": F.col("counts.d")})
    fails = F.concat(F.lit(""), *(F.when(F.expr(sql), letter).otherwise("") for letter, sql in conditions.items()))
    starts = ", ".join(map(str, STARTS))
    kept = f"shiftrightunsigned(xxhash64(substring(text, s + 1, 3 * s + {BLOCK})), {64 - hash_bits})"
    blocks = F.expr(f"transform(filter(array({starts}), s -> s < n_chars), s -> {kept})")
    return rows.select("id", "part", "text", fails.alias("fails"), "n_chars", blocks.alias("blocks"))


#: The class of a row after all its blocks.
CHAIN = "aggregate(blocks, cast(n_chars AS bigint), (c, h) -> xxhash64(c, h))"


def _among(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the given classes; classes are broadcast when they are few, else hot classes are left to the skew join."""
    few = classes.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(classes) if few else classes.hint("merge"), ["n_chars", "class"], "left_semi")


def refined(slim: DataFrame) -> DataFrame:
    """Rows of ``slim(..., n_chars, blocks)`` that share length and all block hashes with another row, with their class."""
    alive, done, k = slim.withColumn("class", F.col("n_chars").cast("long")), None, 0
    while True:
        classes = written(alive.groupBy("n_chars", "class").agg(F.count("*").alias("n")).where("n > 1").select("n_chars", "class"), "classes")
        alive = written(_among(alive, classes), "alive")
        whole = alive.where(F.size("blocks") <= k)
        done = whole if done is None else done.unionByName(whole)
        if not alive.where(F.size("blocks") > k).head(1):
            return done
        alive = alive.where(F.size("blocks") > k).withColumn("class", F.expr(f"xxhash64(class, blocks[{k}])"))
        k += 1


def repeated(slim: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``slim(id, ..., n_chars, blocks)`` whose text is also that of a smaller id, without ``blocks``. ``texts`` are the same rows with their text."""
    left = written(refined(slim).drop("blocks"), "left")
    classes = written(left.select("n_chars", "class").distinct(), "classes")
    full = _among(texts.withColumn("class", F.expr(CHAIN)), classes)
    least = full.groupBy("n_chars", "class", "text").agg(F.min("id").alias("least"))
    least = written(least.groupBy("n_chars", "class").agg(F.count("*").alias("n_texts"), F.min("least").alias("least")), "least")
    few = least.count() <= BROADCAST_IDS
    known = F.broadcast(least) if few else least
    one = left.join(known, ["n_chars", "class"]).where("n_texts = 1 AND id > least").drop("n_texts", "least")
    clashing = least.where("n_texts > 1").select("n_chars", "class")
    if not clashing.head(1):
        return one.drop("class")
    # Different texts with equal hashes throughout: these rows are told apart by their texts.
    rows = written(_among(texts.withColumn("class", F.expr(CHAIN)), clashing), "clashing")
    least = rows.groupBy("n_chars", "class", "text").agg(F.min("id").alias("least"))
    apart = rows.join(least, ["n_chars", "class", "text"]).where("id > least")
    return one.select(*slim.drop("blocks").columns).unionByName(apart.select(*slim.drop("blocks").columns))


def orders(letters: str) -> Column:
    """All orders of the filters, as an array of strings; they are a constant of the plan."""
    return F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")


def failures(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", label_id: str = "doc_id", hash_bits: int = 64) -> DataFrame:
    """(part, fails, n, good, toxic): rows counted by part and by the letters of the filters that they fail, ``REPEATED`` included."""
    texts = measured(docs, conditions, id_col, text_col, part_col, hash_bits)
    slim = written(texts.drop("text"), "slim")
    marks = labels.select(F.col(label_id).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id is not null and (good or toxic)")
    marks = written(marks.groupBy("id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic")), "marks")
    few = marks.count() <= BROADCAST_IDS
    marks = F.broadcast(marks) if few else marks

    def counted(rows: DataFrame) -> DataFrame:
        rows = rows.select("id", "part", "fails").join(marks, "id", "left")
        return rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    again = counted(repeated(slim, texts))
    plus = again.withColumn("fails", F.concat("fails", F.lit(REPEATED)))
    minus = again.select("part", "fails", *((-F.col(c)).alias(c) for c in ("n", "good", "toxic")))
    every = counted(slim).unionByName(plus).unionByName(minus)
    return every.groupBy("part", "fails").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS, **options) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty, null parts the part ''. A row with a null id is counted but has no label, repeats no other and is repeated by none; rows that
    share id and text do not repeat each other, but both repeat the text of a smaller id. A document with several label rows is good or toxic if one
    of them says so. Texts of any length are read and compared whole. Extra columns are ignored. No documents give no rows; no labels give zeros.
    """
    letters = "".join(conditions) + REPEATED
    counts = written(failures(docs, labels, conditions, **options), "counts")
    steps = counts.select("*", F.explode(orders(letters)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    # A row is gone before a step if one of the letters before it is among those that the row fails.
    own, early = "instr(fails, substring(filter_order, step, 1)) > 0", "length(translate(substring(filter_order, 1, step - 1), fails, '')) < step - 1"
    steps = steps.withColumns({"own": F.expr(own), "early": F.expr(early)})

    def total(what: str, when: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(when), F.col(what))), F.lit(0)).cast("long")

    size = factorial(len(letters))
    shapley = F.coalesce(F.sum(F.when(F.col("own"), F.col("n") * F.expr(f"{size} div length(fails)"))), F.lit(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total("n", "NOT own AND NOT early").alias("kept"), total("n", "own AND NOT early").alias("removed"), total("n", "own AND early").alias("redundant"),
        total("n", "own AND length(fails) = 1").alias("unique_fails"), total("good", "own AND NOT early").alias("good_lost"), total("toxic", "own AND NOT early").alias("toxic_lost"), shapley.alias("shapley"),
    )
