"""Sessions and pairs of large projects: what is copied and made for them grows with the tasks and the result, not with the projects' squares on the way."""

from pyspark.sql import functions as F

from focalframe.operators import projects


def test_sessions_copy_their_project_text_around_their_own_id(spark):
    made = [("p", k, "view" if k % 3 == 0 else "result") for k in range(95, 1300)] + [("q", k, "result") for k in (7, 8, 8)] + [("r", -7, "result"), ("s", 1, "view"), (None, 2, "result"), ("q", None, "result")]
    images = spark.createDataFrame(made, "project_id string, image_id bigint, kind string").coalesce(1)
    targets = spark.createDataFrame([("p", k) for k in (95, 96, 97, 100, 998, 1000, 1001, 1298, 1299)] + [("q", 7), ("q", 8), ("r", -7), ("s", 1), ("t", 1), ("q", None)], "project_id string, image_id bigint").coalesce(1)
    wanted = set(map(tuple, targets.collect()))
    held = {p: sorted({k for q, k, kind in made if q == p and kind == "result" and k is not None}) for p in "pqr"}
    want = sorted((p, k, ",".join(str(j) for j in held[p] if j != k)) for p, k, kind in made if kind == "result" and p and k is not None and (p, k) in wanted)
    text = projects.new_sessions(images, targets, text=True)
    assert sorted((r["project_id"], r["image_id"], r["sources"]) for r in text.collect()) == want
    lists = projects.new_sessions(images, targets)
    assert sorted((r["project_id"], r["image_id"], ",".join(map(str, r["sources"]))) for r in lists.collect()) == want


def test_sessions_of_one_project_are_dealt_to_tasks(spark):
    images = spark.createDataFrame([("p", k, "result") for k in range(3000)], "project_id string, image_id bigint, kind string").coalesce(1)
    out = projects.new_sessions(images, images.where("image_id % 7 = 0").select("project_id", "image_id"), text=True)
    assert out.select(F.spark_partition_id().alias("task")).distinct().count() > 3


def test_sizes_are_compared_with_lists_and_not_with_pairs(spark):
    images = spark.createDataFrame([("p", k, "result", k % 2, None if k % 7 == 3 else k % 3) for k in range(50)], "project_id string, image_id bigint, kind string, width int, height int")
    out = projects.retouch_sources(images, images.where("image_id < 9").select("project_id", "image_id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("AS fits")

    def fits(t, s):
        differ = t % 2 != s % 2 or 3 not in (t % 7, s % 7) and t % 3 != s % 3
        return False if differ else None if 3 in (t % 7, s % 7) else True

    assert {(r["target"], r["source"]): r["fits"] for r in out.collect()} == {(t, s): fits(t, s) for t in range(9) for s in range(50) if s != t}
