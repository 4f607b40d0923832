"""URL filter with DataFrame functions only: fixed rules first, then a path-template tree for each host.

The tree is grown from fork to fork, to the end of the longest path. Below each node a segment with enough labels whose
share of bad pages differs from that of the others stays apart, however many siblings it has. Else the segments that are rare
among the node's pages are variable and become a wildcard, and of the others those that do not differ are
merged into one branch. A path's templates end in a leaf; leaves are judged by their labelled purity, smoothed towards
the purity of their host, and that towards the purity of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written

#: Fixed values: (host, path, verdict) of the production rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Share of a node's pages below which a segment is variable, unless it has enough labels to be judged for itself.
RARE = 0.05
ENOUGH = 20
#: Standard errors that a branch's share of bad pages must lie from its siblings' to stay apart; weight of the prior purity; least purity.
APART = 1.96
PRIOR = 4.0
PURITY = 0.5
#: Fixed names of template segments: a variable one, merged ones.
WILDCARD, MERGED = "*", "+"


def split_url(url: str) -> tuple[Column, Column]:
    """Host and path of a url column; both empty for null or without ``://``."""
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END"
    host = F.translate(F.regexp_extract(F.expr(rest), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.expr(rest), r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules: tuple[tuple[str, str, str], ...], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _joined(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Rows with what a table of nodes says; it is broadcast when its counted rows are few."""
    few = small.count() <= BROADCAST_IDS // 16
    return rows.join(F.broadcast(small) if few else small, on, "left")


def _without_forks(rows: DataFrame) -> DataFrame:
    """Open rows led over the segments that all rows of their node have in common: these would be merged one by one, or be variable where there is one row only."""
    rest = F.expr("slice(__parts, __at + 1, size(__parts))")
    nodes = rows.groupBy("host", "template").agg(F.count("*").alias("n"), F.min(rest).alias("low"), F.max(rest).alias("high"))
    # What the least and the greatest of the paths share, all paths between them share.
    fork = "array_position(transform(low, (x, i) -> coalesce(get(high, i) = x, false)), false)"
    steps = F.expr(f"cast(CASE WHEN {fork} > 0 THEN {fork} - 1 ELSE size(low) END AS int)")
    nodes = written(nodes.select("host", "template", F.when(F.col("n") > 1, MERGED).otherwise(WILDCARD).alias("__name"), steps.alias("__steps")), "nodes")
    named = _joined(rows, nodes, ["host", "template"])
    return named.withColumn("template", F.concat("template", F.expr("repeat(concat('/', __name), __steps)"))).withColumn("__at", F.col("__at") + F.col("__steps")).drop("__name", "__steps")


def path_templates(pages: DataFrame) -> DataFrame:
    """``pages(host, path, bad)`` (bad is 1, 0 or null) with ``template`` added: the leaf each path falls in.

    A round leads every open path to the next fork and past it, so there are as many rounds as forks on a path, however long it is; paths that have ended leave.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = written(pages.withColumn("__parts", parts).withColumn("template", F.lit("")).withColumn("__at", F.lit(0)), "rows")
    done = rows.where("__at >= size(__parts)")
    rows = rows.where("__at < size(__parts)")
    while rows.head(1):
        led = written(_without_forks(rows), "led")
        done = done.unionByName(led.where("__at >= size(__parts)"))
        rows = led.where("__at < size(__parts)").withColumn("__segment", F.expr("__parts[__at]"))
        here = rows.groupBy("host", "template", "__segment").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.sum(F.coalesce(F.col("bad"), F.lit(0))).alias("worse"))
        here = written(here, "branches")
        node = here.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("known").alias("all_known"), F.sum("worse").alias("all_worse"))
        rest = F.col("all_known") - F.col("known")
        pooled = F.try_divide("all_worse", "all_known")
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "known") + F.try_divide(F.lit(1.0), rest)))
        gap = F.try_divide("worse", "known") - F.try_divide(F.col("all_worse") - F.col("worse"), rest)
        differs = F.coalesce(F.abs(gap) > APART * spread, F.lit(False))
        rare = F.col("n") < F.greatest(F.lit(2.0), RARE * F.col("all_n"))
        name = F.when(differs & (F.col("known") >= ENOUGH), F.col("__segment")).when(rare, WILDCARD).when(differs, F.col("__segment")).otherwise(MERGED)
        named = written(here.join(node, ["host", "template"]).select("host", "template", "__segment", name.alias("__name")), "names")
        rows = _joined(rows, named, ["host", "template", "__segment"])
        rows = written(rows.withColumn("template", F.concat("template", F.lit("/"), "__name")).withColumn("__at", F.col("__at") + 1).drop("__name", "__segment"), "rows")
        done = done.unionByName(rows.where("__at >= size(__parts)"))
        rows = rows.where("__at < size(__parts)")
    return done.drop("__parts", "__at")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    ``labels(page_id, bad)`` marks some pages 1 (bad) or 0; other values, nulls and null ids say nothing, and of several labels
    of a page the worst counts. A null url, or one without ``://``, has an empty host and path and belongs to the
    template of the empty host. Hosts without labels are judged by the overall purity; without any label all is pure. Rows
    with a null or repeated id are judged like others. Of rules of equal length the later one counts; urls of any length are read whole. Other columns are ignored; no pages give no rows.
    """
    host, path = split_url("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.where("page_id is not null and bad in (0, 1)").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    rows = written(path_templates(_joined(rows, marks, ["page_id"])), "templates")
    leaves = written(rows.groupBy("host", "template").agg(F.count("bad").alias("known"), F.sum(F.coalesce(1 - F.col("bad"), F.lit(0))).alias("good")), "leaves")
    hosts = leaves.groupBy("host").agg(F.sum("known").alias("host_known"), F.sum("good").alias("host_good"))
    known, good = hosts.agg(F.sum("host_known"), F.sum("host_good")).first()
    base = good / known if known else 1.0
    purity = F.expr(f"(good + {PRIOR}D * ((host_good + {PRIOR}D * {base!r}D) / (host_known + {PRIOR}D))) / (known + {PRIOR}D)")
    leaves = written(leaves.join(hosts, "host").select("host", "template", purity.alias("purity")), "purity")
    rule, verdict = rule_for(rules)
    judged = F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    return _joined(rows, leaves, ["host", "template"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "template", "purity")
