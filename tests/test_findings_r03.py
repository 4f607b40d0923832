"""Stacks whose frames have different heights, long chains, and more strokes than a checkpoint holds."""

import duckdb
import numpy as np
import pytest
from conftest import DATA, plain
from pyspark.sql import functions as F

from focalframe import plans
from focalframe.operators import geometry, projects, retouch
from focalframe.sources.store import RetouchImages


def uneven(spark, folder, n=203):
    """Embeddings of which the first frames get a row more than the others."""
    rng = np.random.default_rng(3)
    spark.createDataFrame([(k, rng.uniform(-1, 1, 64).tolist()) for k in range(n)], "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")


def against_sql(spark, folder, name, tables=("embeddings",)):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert plain(plans.QUERIES[name](spark, str(folder)).toPandas()) == plain(con.execute(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["tile_feather", "tiled_weighted"])
def test_frames_of_uneven_height(spark, tmp_path, name):
    uneven(spark, tmp_path)
    against_sql(spark, tmp_path, name)


def test_a_long_chain_is_folded_in_blocks(spark):
    n, ref = 1500, 700
    rng = np.random.default_rng(5)
    links = [np.array([[1 + rng.normal() / 1000, rng.normal() / 1000, rng.normal()], [rng.normal() / 1000, 1 + rng.normal() / 1000, rng.normal()], [0, 0, 1]]) for _ in range(n - 1)]
    pairs = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(links) if k != 1200], "link int, m array<double>")
    out = geometry.chain_to_reference(pairs, n, ref)
    # Nothing is paired but by equality: the work grows with the chain.
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    got = {r["frame"]: np.reshape(r["m"], (3, 3)) for r in out.collect()}
    want = {ref: np.eye(3)}
    for f in range(ref + 1, n):
        want[f] = want[f - 1] if f == 1201 else links[f - 1] @ want[f - 1]
    for f in range(ref - 1, -1, -1):
        want[f] = np.linalg.inv(links[f]) @ want[f + 1]
    assert set(got) == set(want) and all(np.allclose(got[f], want[f], rtol=1e-9, atol=1e-9) for f in want)


def test_every_part_meets_the_reference(spark, duck):
    got = plans.QUERIES["direct_reference"](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/part.parquet").count()
    assert plain(got.toPandas()) == plain(duck.sql(plans.ORACLES["direct_reference"]).df())
    assert "direct_planted" in plans.QUERIES


def test_a_session_over_a_tall_image(spark, tmp_path):
    uneven(spark, tmp_path, 703)
    spark.read.parquet(f"{DATA}/supplier.parquet").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    against_sql(spark, tmp_path, "flatten_session", ("embeddings", "supplier"))


def test_checkpoints_are_made_in_one_pass(spark, tmp_path, monkeypatch):
    base = spark.range(80).selectExpr("cast(id div 8 AS int) AS y", "cast(id % 8 AS int) AS x", "cast(id AS double) AS v")
    sources = base.selectExpr("1 AS source", "y", "x", "v + 50 AS s")
    strokes = spark.range(30).selectExpr("id AS seq", "id + 1 AS position", "array(named_struct('x', cast(id % 8 AS double), 'y', cast(id % 5 AS double), 'p', 1D)) AS points", "2D AS radius", "0.5D AS hardness", "0.5D AS opacity", "'paint' AS mode", "1 AS source")
    store, passes = RetouchImages(spark, f"{tmp_path}/images", 6, 8, every=5), []
    replace = store.images.replace
    monkeypatch.setattr(store.images, "replace", lambda rows: (passes.append(1), replace(rows)))
    assert store.save(base, strokes, sources) == 6 and len(passes) == 1
    for n in (30, 17, 3):
        image, replayed = store.after(base, strokes, sources, n)
        want = retouch.retouched(base, strokes.where(f"position <= {n}"), sources, 6, 8)
        assert sorted(map(tuple, image.collect())) == sorted(map(tuple, want.collect())) and replayed == n % 5


def test_a_hard_mask_fills_its_box_and_is_drawn_in_place(spark):
    stroke = [(1, [(0.0, 0.0, 1.0), (60.0, 45.0, 0.5)], 2.0, 0.75)]
    strokes = spark.createDataFrame(stroke, "seq bigint, points array<struct<x:double,y:double,p:double>>, radius double, hardness double")
    out = retouch.stroke_masks(strokes, 50, 64)
    assert "Generate explode" not in out._jdf.queryExecution().toString()
    got = {(r["py"], r["px"]): r["mask"] for r in out.collect()}
    assert set(got) == {(y, x) for y in range(48) for x in range(63)} and got[0, 0] == 1 and got[0, 62] == 0


def test_a_warp_by_blocks_turns_and_tilts_a_frame(spark):
    height, width = 150, 90
    rng = np.random.default_rng(8)
    image = rng.integers(0, 255, (height, width))
    c, s = np.cos(0.5), np.sin(0.5)
    moves = [np.array([[c, -s, 20.0], [s, c, -9.0], [0, 0, 1]]), np.array([[1.1, 0.02, -4], [0.01, 0.95, 3], [1e-3, -2e-4, 1]]), np.array([[1, 0, 2], [0, 1, 3], [0.02, 0, -1.0]])]
    frames = spark.createDataFrame([(f, y, image[y].tolist(), height) for f in range(3) for y in range(height)], "frame int, y int, row array<bigint>, height int")
    out = geometry.warp(frames, spark.createDataFrame([(f, m.ravel().tolist()) for f, m in enumerate(moves)], "frame int, m array<double>"), "bilinear")
    # Taps are not rows of a join.
    plan = out._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "(width - 1))" not in plan
    got = {(r["frame"], r["y"], r["x"]): r["v"] for r in out.collect()}
    assert len(got) == 3 * height * width
    for f, m in enumerate(moves):
        for y, x in rng.integers(0, (height, width), (300, 2)):
            px, py, depth = m @ (x, y, 1.0)
            depth = depth if abs(depth) >= 1e-8 else 1e-8
            sx, sy = px / depth, py / depth
            fx, fy = np.floor(sx), np.floor(sy)
            at = lambda i, j: image[int(min(max(i, 0), height - 1)), int(min(max(j, 0), width - 1))]
            want = sum(at(fy + i, fx + j) * (1 - abs(sy - fy - i)) * (1 - abs(sx - fx - j)) for i in (0, 1) for j in (0, 1))
            assert abs(got[f, y, x] - want) < 1e-6


def test_sessions_take_their_project_list_without_pairs(spark):
    images = spark.range(60).selectExpr("id % 3 AS project_id", "id AS image_id", "CASE WHEN id = 4 THEN 'view' ELSE 'result' END AS kind", "1 AS width", "1 AS height")
    images = images.where("project_id < 2 OR image_id = 5")
    out = projects.new_sessions(images, images.where("image_id % 5 = 0 OR image_id = 4").select("project_id", "image_id"))
    assert "NOT (image_id" not in out._jdf.queryExecution().toString()
    held = {r["image_id"]: r["project_id"] for r in images.where("kind = 'result'").collect()}
    want = {k: [j for j in sorted(held) if held[j] == p and j != k] for k, p in held.items() if k % 5 == 0}
    assert {r["image_id"]: r["sources"] for r in out.collect()} == want and want[5] == []


def test_the_pairs_of_one_project_are_dealt_to_tasks(spark):
    made = [("p", k, "view" if k % 3 == 0 else "result", None if k % 50 == 1 else k % 2, k % 3) for k in range(12000)] + [("q", k, "result", 1, 1) for k in (7, 8, 8)] + [("r", 7, "result", 1, 1)]
    images = spark.createDataFrame(made, "project_id string, image_id bigint, kind string, width int, height int").coalesce(1)
    targets = spark.createDataFrame([("p", k) for k in range(0, 12000, 490)] + [("q", 7), ("q", 8), ("r", 7), ("s", 1)], "project_id string, image_id bigint").coalesce(1)
    out = projects.retouch_sources(images, targets)
    assert out.select(F.spark_partition_id().alias("task")).distinct().count() > 3
    wanted = set(map(tuple, targets.collect()))
    results = [r for r in made if r[2] == "result"]

    def fits(t, s):
        pairs = ((t[3], s[3]), (t[4], s[4]))
        return False if any(None not in p and p[0] != p[1] for p in pairs) else None if any(None in p for p in pairs) else True

    want = [(t[0], t[1], s[1], fits(t, s)) for t in results if t[:2] in wanted for s in results if s[0] == t[0] and s[1] != t[1]]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
