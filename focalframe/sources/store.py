"""Tables that are brought up to date in place: aligned frames, viewer tiles, retouch checkpoints.

Each store is a Parquet table partitioned by what is rewritten as one. A join decides which partitions are out of date, only their rows are made, and
they replace the old ones by dynamic partition overwrite; all others stay as they are. Data are written before the manifest that
vouches for them, so that a run that dies between the two is simply repeated.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, retouch
from ..raster import BAND
from ..scratch import exists, fresh_path, remove, written
from .frames import export_frames

VERSION = 2

__all__ = ["AlignedCache", "DocumentStore", "PartitionedTable", "RetouchImages", "TileStore", "fresh_path"]


class PartitionedTable:
    """A Parquet table in a folder, partitioned by ``by``; its schema has the partition columns last."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: list[str]) -> None:
        self.spark, self.path, self.schema, self.by = spark, path, schema, by

    def read(self) -> DataFrame:
        """The table; partitions of a folder that does not exist yet are none."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """Puts ``rows`` in the place of the partitions that they have rows of; other partitions are not touched."""
        dealt = rows.repartition(*self.by)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*self.by).parquet(self.path)

    def drop(self, partitions: DataFrame) -> None:
        """Removes partitions; their values, a row for each, come to the driver."""
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in partitions.select(*self.by).distinct().collect():
            remove(self.spark, self.path + "".join(f"/{c}={escaped(str(row[c]))}" for c in self.by))


def frame_keys(frames: DataFrame, transforms: DataFrame) -> DataFrame:
    """(frame, key, height): a digest of each frame's samples and transform. Rows are digested where they are; one short digest a row is gathered."""
    rows = frames.select("frame", "y", "height", F.sha2(F.to_json(F.struct("y", "row")), 256).alias("d"))
    whole = rows.groupBy("frame").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "d"))), lambda r: r["d"]), ""), 256).alias("samples"), F.max("height").alias("height"))
    return whole.join(transforms, "frame").select("frame", F.sha2(F.concat("samples", F.to_json(F.struct("m"))), 256).alias("key"), "height")


class AlignedCache:
    """Aligned frames with their validity masks, by frame and band of rows.

    The manifest holds, for each frame, the digest that it was made from, besides version, domain and source of the whole cache; a cache of another
    version, domain or source is refused. ``refresh`` warps only frames whose digest differs.
    """

    def __init__(self, spark: SparkSession, path: str, domain: str = "rendered_rgb", source_hash: str = "", version: int = VERSION) -> None:
        self.spark, self.domain, self.source_hash, self.version = spark, domain, source_hash, version
        self.rows = PartitionedTable(spark, f"{path}/rows", "y int, row array<double>, valid array<boolean>, frame int, band int", ["frame", "band"])
        self.manifest = PartitionedTable(spark, f"{path}/manifest", "key string, height int, version int, domain string, source_hash string, frame int", ["frame"])
        other = self.manifest.read().where((F.col("version") != version) | (F.col("domain") != domain) | ((F.col("source_hash") != source_hash) if source_hash else F.lit(False)))
        if other.head(1):
            raise ValueError(f"the cache at {path} belongs to another version, domain or source")

    def refresh(self, frames: DataFrame, transforms: DataFrame, kernel: str = "bilinear") -> DataFrame:
        """(frame, verdict): new, rewritten, kept or removed, for ``frames(frame, y, row, height)`` through ``transforms(frame, m)``. Verdicts, one a frame, are held by the driver."""
        keys, known = frame_keys(frames, transforms), self.manifest.read().select("frame", F.col("key").alias("stored"))
        verdict = F.when(F.col("key").isNull(), "removed").when(F.col("stored").isNull(), "new").when(F.col("key") == F.col("stored"), "kept").otherwise("rewritten")
        verdicts = keys.join(known, "frame", "full").select("frame", "key", "height", verdict.alias("verdict")).collect()
        told = self.spark.createDataFrame(verdicts, "frame int, key string, height int, verdict string")
        stale = told.where("verdict IN ('new', 'rewritten')")
        if stale.head(1):
            part = frames.join(F.broadcast(stale.select("frame")), "frame", "left_semi")
            moved = transforms.join(F.broadcast(stale.select("frame")), "frame", "left_semi")
            self.rows.replace(self._made(part, moved, kernel))
            self.manifest.replace(stale.select("key", F.col("height").cast("int").alias("height"), F.lit(self.version).alias("version"), F.lit(self.domain).alias("domain"), F.lit(self.source_hash).alias("source_hash"), "frame"))
        gone = told.where("verdict = 'removed'")
        if gone.head(1):
            self.manifest.drop(gone)
            for row in gone.select("frame").collect():
                remove(self.spark, f"{self.rows.path}/frame={row['frame']}")
        return told.select("frame", "verdict")

    def _made(self, frames: DataFrame, transforms: DataFrame, kernel: str) -> DataFrame:
        values, valid = geometry.warp(frames, transforms, kernel), geometry.warp_mask(frames, transforms)
        packed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("x", c))), lambda p: p[c])
        rows = values.join(valid, ["frame", "y", "x"]).withColumn("v", F.col("v").cast("double")).groupBy("frame", "y").agg(packed("v").alias("row"), packed("valid").alias("valid"))
        return rows.select("y", "row", "valid", "frame", F.expr(f"cast(y div {BAND} AS int)").alias("band"))

    def read(self) -> DataFrame:
        """(frame, y, row, valid, height); conditions on frame prune partitions. Bands beyond a frame that has become lower are passed over."""
        known = self.manifest.read().select("frame", "height")
        return self.rows.read().join(F.broadcast(known), "frame").where("y < height").select("frame", "y", "row", "valid", "height")


class TileStore:
    """Deep-zoom tiles of an image, by level and tile; ``dy`` numbers a tile's rows."""

    def __init__(self, spark: SparkSession, path: str, height: int, width: int, tile: int = 256) -> None:
        self.height, self.width, self.tile = height, width, tile
        self.tiles = PartitionedTable(spark, path, "dy int, row array<double>, z int, ty int, tx int", ["z", "ty", "tx"])

    def _rows(self, image: DataFrame, only: DataFrame | None = None) -> DataFrame:
        return retouch.tile_rows(image, self.height, self.width, self.tile, only).select(F.col("dy").cast("int").alias("dy"), "row", "z", "ty", F.col("tx").cast("int").alias("tx"))

    def build(self, image: DataFrame) -> None:
        """Stores all tiles of ``image(y, row)``."""
        self.tiles.replace(self._rows(image))

    def update(self, image: DataFrame, boxes: DataFrame) -> DataFrame:
        """(z, ty, tx): the tiles that ``boxes(id, y0, x0, y1, x1)`` touch, made again from ``image``; rows that no such tile needs are not resampled."""
        dirty = retouch.dirty_tiles(boxes, self.width, self.height, self.tile).select("z", "ty", "tx").distinct()
        self.tiles.replace(self._rows(image, dirty).join(dirty, ["z", "ty", "tx"], "left_semi"))
        return dirty

    def read(self) -> DataFrame:
        return self.tiles.read()


class DocumentStore:
    """JSON documents by key, such as projects and presets: one partition a document, so that saving some leaves the others alone.

    ``schema`` is the document's, without the key. A document that does not parse, or whose ``needed`` fields are missing, is passed over in reading.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, needed: tuple[str, ...] = ()) -> None:
        self.key, self.schema, self.needed = key, schema, needed
        self.documents = PartitionedTable(spark, path, f"document string, {key} string", [key])

    def save(self, rows: DataFrame) -> None:
        """Stores or replaces the documents of ``rows(key, fields...)``."""
        fields = [c for c in rows.columns if c != self.key]
        self.documents.replace(rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"), F.col(self.key).cast("string").alias(self.key)))

    def delete(self, keys: DataFrame) -> None:
        self.documents.drop(keys.select(F.col(self.key).cast("string").alias(self.key)))

    def load(self) -> DataFrame:
        """The documents' fields beside their key."""
        parsed = self.documents.read().withColumn("d", F.from_json("document", self.schema))
        whole = parsed.where("d IS NOT NULL").select(self.key, "d.*")
        return whole.dropna(subset=list(self.needed)) if self.needed else whole


class RetouchImages:
    """Images of a retouch session (the pixels that strokes can reach) after every ``every`` strokes; undo starts from the latest one at or before the stroke it goes back to."""

    def __init__(self, spark: SparkSession, path: str, height: int, width: int, every: int = 20) -> None:
        self.height, self.width, self.every = height, width, every
        self.images = PartitionedTable(spark, path, "y int, x int, v double, at bigint", ["at"])

    def _after(self, base: DataFrame, strokes: DataFrame, sources: DataFrame, n: int, at: int) -> DataFrame:
        """The image after ``n`` strokes, from the one stored ``at`` (0: the base). ``strokes`` have ``position`` from 1."""
        some = strokes.where((F.col("position") > at) & (F.col("position") <= n))
        return retouch.retouched(base, some, sources, self.height, self.width, self._stored(at))

    def _stored(self, at: int) -> DataFrame | None:
        return self.images.read().where(F.col("at") == at).select("y", "x", "v") if at else None

    def save(self, base: DataFrame, strokes: DataFrame, sources: DataFrame) -> int:
        """Stores what is missing of the checkpoints of ``strokes(position, seq, ...)``. The number of checkpoints made."""
        last = strokes.agg(F.max("position")).first()[0] or 0
        held = {r["at"] for r in self.images.read().select("at").distinct().collect()}
        missing = [at for at in range(self.every, last + 1, self.every) if at not in held]
        # A run of missing ones is made in one pass, from the checkpoint before it.
        for first in [at for at in missing if at - self.every not in missing]:
            run = [at for at in missing if at >= first and all(k not in held for k in range(first, at, self.every))]
            some = strokes.where((F.col("position") > first - self.every) & (F.col("position") <= run[-1]))
            self.images.replace(retouch.images_after(base, some, sources, self.height, self.width, run, self._stored(first - self.every)).select("y", "x", "v", "at"))
        return len(missing)

    def forget_after(self, n: int) -> None:
        """Drops checkpoints of strokes that an undo has taken back."""
        self.images.drop(self.images.read().where(F.col("at") > n).select("at"))

    def after(self, base: DataFrame, strokes: DataFrame, sources: DataFrame, n: int) -> tuple[DataFrame, int]:
        """The image after ``n`` strokes and how many were replayed for it, fewer than ``every`` where all checkpoints are stored."""
        at = self.images.read().where(F.col("at") <= n).agg(F.max("at")).first()[0] or 0
        return self._after(base, strokes, sources, n, at), n - at

    def flatten(self, image: DataFrame, folder: str, session: str, name: str) -> dict[str, str]:
        """Exports an image (y, x, v in 0 to 255) of a session as a 16-bit file and returns the record of the new result: image_id, kind, path, method, name."""
        image_id = hashlib.sha256(session.encode()).hexdigest()[:12]
        packed = F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"] / 255.0)
        rows = written(image.groupBy("y").agg(packed.alias("row")), "flattened")
        # The image may reach beyond what strokes do.
        height = (rows.agg(F.max("y")).first()[0] or 0) + 1
        export_frames(rows.select(F.lit(0).alias("frame"), F.col("y").cast("int").alias("y"), *(F.col("row").alias(c) for c in "rgb"), F.lit(height).cast("int").alias("height")), f"{folder}/{image_id}", bits=16)
        return {"image_id": image_id, "kind": "result", "path": f"{folder}/{image_id}/0000.tif", "method": "retouch", "name": name}
