"""Components of similarity links between items that share keys, without listing all pairs of a group.

Items are 64-bit class ids; exact copies share one and so never form pairs. Items that share a key are
candidates, unless fingerprints that travel with them (marks) prove them apart. Small groups give all their pairs. Of a larger one each
item is compared with a central item first; what the verified links leave in several components is then compared completely
across components, by the caller's test and in parts of bounded size, so no link that joins two components is lost, while pairs inside a component are
never listed. Keys that many items share are never gathered: the sending tasks pass their items by as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written
from .textkernel import mix

U = np.uint64


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Large-star and small-star steps alternate until the edges no longer change; each step is written to the shared
    folder. Self links and repeated edges are allowed; null ends are left out; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, state = _observed(edges.distinct())
    seen = None
    while state != seen and state[0]:
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, state = _observed(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct())
    return edges.select("a", F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("a"), F.col("b").alias("component"))).withColumnRenamed("a", "node").distinct()


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges as a table, with their number and a sum that tells them from others, taken while they are written."""
    seen = Observation()
    table = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    return table, (seen.get["n"], seen.get["sum"])


#: Keys that one task groups, about; keys that a sending task gathers before it sends them off; items of a key that it sends packed.
BUCKET_KEYS = 2_000_000
SENT_KEYS = 1_000_000
HOT = 256
_PACKED = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary()), ("refs", pa.binary()), ("hot", pa.binary())])
PACKED = "bucket long, keys binary, ids binary, marks binary, refs binary, hot binary"
_GROUPED = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
GROUPED = "key long, a long, b long"
#: Members of a key group that are compared with each other before it is sent on; larger groups are sent on whole. Members of a
#: cluster that gives all its pairs; passes that labels may take to settle.
COMPARED = 2048
PAIRED = 6
PASSES = 6
#: Pairs of neighbours that are kept for the next pass at most; more are found again.
HELD = 4_000_000
#: Items of a group that one task compares with all others of the group.
PART = 4096
#: Keys of large groups that an item names at most, so that its pairs are made once.
FEW_KEYS = 16

#: A test on two arrays of marks, a row of 64-bit words for each item.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _named(short: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """The name of a key by its 48 low bits and its bucket."""
    return (short.astype(np.int64) << 15) ^ bucket


def _by_key(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by key, then id; only what shares a key is sorted by both."""
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    shared = np.flatnonzero(same[1:] | same[:-1])
    some = order[shared]
    order[shared] = some[np.lexsort((ids[some], keys[some]))]
    return order


class Packer:
    """Gathers (key, id) pairs and sends them as one row per bucket: 48 bits of each key, and short references to the ids.

    The highest bits of a key choose the bucket; pairs of different keys that agree in bucket and 48 bits only add candidates. Of a
    key with more than ``HOT`` ids in hand one id is packed; all of them go past the buckets in a row of their own.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets, self.keys, self.ids, self.marks, self.size, self.sent = buckets, [], [], [], 0, 0

    def add(self, keys: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``marks`` are fingerprints of the ids that travel with them, a row of 64-bit words each."""
        self.keys.append(keys)
        self.ids.append(ids)
        self.marks.append(marks)
        self.size += len(keys)
        if self.size >= SENT_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, ids, marks = (np.concatenate(x) for x in (self.keys, self.ids, self.marks))
        self.keys, self.ids, self.marks, self.size = [], [], [], 0
        order = _by_key(keys, ids)
        keys, ids, marks = keys[order], ids[order], marks[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids, marks = keys[new], ids[new], marks[new]
        bucket = (keys >> U(48)).astype(np.int64) * self.buckets >> 16 if self.buckets <= 1 << 16 else (mix(keys) % U(self.buckets)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        rows, hot = [], np.repeat(sizes > HOT, sizes)
        if hot.any():
            names = _named(keys[hot] & U((1 << 48) - 1), bucket[hot])
            self.sent += 1
            past = self.buckets + int(mix(ids[:1].view(U) + U(self.sent))[0] >> U(20))
            rows.append((past, names.tobytes(), ids[hot].tobytes(), b"", b"", b""))
            kept = ~hot
            kept[starts] = True
            keys, ids, marks, bucket, hot = (x[kept] for x in (keys, ids, marks, bucket, hot))
        order = np.argsort(bucket, kind="stable")
        keys, ids, marks, bucket, hot = (x[order] for x in (keys, ids, marks, bucket, hot))
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=self.buckets))
        for lo, hi in zip(edges, edges[1:]):
            own, first, refs = np.unique(ids[lo:hi], return_index=True, return_inverse=True)
            refs = refs.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
            short = np.ascontiguousarray(keys[lo:hi]).view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((int(bucket[lo]), short.tobytes(), own.tobytes(), marks[lo:hi][first].tobytes(), refs.tobytes(), np.flatnonzero(hot[lo:hi]).astype(np.int32).tobytes()))
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


_THIN = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("hot", pa.binary())])
THIN = "bucket long, keys binary, ids binary, hot binary"
#: Bytes of a key that are sent beside its bucket.
THIN_KEY = 5


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, and 40 bits of what the bucket leaves open; both grow with the key."""
    n = U(buckets)
    with np.errstate(over="ignore"):
        return ((keys >> U(32)) * n + ((keys & U(0xFFFFFFFF)) * n >> U(32)) >> U(32)).astype(np.int64), keys * n >> U(64 - 8 * THIN_KEY)


def _thin_name(short: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """The name of a key by the 40 bits beside its bucket."""
    return (short.astype(np.int64) << (64 - 8 * THIN_KEY)) ^ bucket


class ThinPacker:
    """Gathers (key, id) pairs and sends them as one row per bucket: 40 bits of each key and the whole id, 13 bytes a pair whatever the number of buckets.

    For items whose keys are seldom shared: nothing travels that would tell shared ones apart. Hot keys are sent as by ``Packer``.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets, self.keys, self.ids, self.size, self.sent = buckets, [], [], 0, 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.ids.append(ids)
        self.size += len(keys)
        if self.size >= SENT_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
        self.keys, self.ids, self.size = [], [], 0
        order = _by_key(keys, ids)
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[new], ids[new]
        bucket, short = _dealt(keys, self.buckets)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        rows, hot = [], np.repeat(sizes > HOT, sizes)
        if hot.any():
            self.sent += 1
            past = self.buckets + int(mix(ids[:1].view(U) + U(self.sent))[0] >> U(20))
            rows.append((past, _thin_name(short[hot], bucket[hot]).tobytes(), ids[hot].tobytes(), b""))
            kept = ~hot
            kept[starts] = True
            ids, bucket, short, hot = (x[kept] for x in (ids, bucket, short, hot))
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=self.buckets))
        for lo, hi in zip(edges, edges[1:]):
            # A plane for each byte: the first ones of sorted keys repeat, which compression takes out.
            planes = np.ascontiguousarray(short[lo:hi]).view(np.uint8).reshape(-1, 8)[:, :THIN_KEY].T
            rows.append((int(bucket[lo]), planes.tobytes(), ids[lo:hi].tobytes(), np.flatnonzero(hot[lo:hi]).astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _THIN)], schema=_THIN)


def _thin_grouped(buckets: int):
    """The candidates of a bucket of ``ThinPacker`` rows: pairs (key null) of two ids, and the members (b null) of groups too large to be listed in pairs.

    A large group gives the pairs of one of its ids with all others as well: that of the least hash, which is the same for groups that share most of their ids.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= buckets:
            names, ids = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table[c]]) for c in ("keys", "ids"))
            return pa.table([pa.array(names), pa.array(ids), pa.nulls(len(ids), pa.int64())], schema=_GROUPED)
        parts: list[list[np.ndarray]] = [[], [], []]
        for k, i, h in zip(*(table[c] for c in ("keys", "ids", "hot"))):
            own = np.frombuffer(i.as_buffer(), np.int64)
            wide = np.zeros((len(own), 8), np.uint8)
            wide[:, :THIN_KEY] = np.frombuffer(k.as_buffer(), np.uint8).reshape(THIN_KEY, -1).T
            hot = np.zeros(len(own), bool)
            hot[np.frombuffer(h.as_buffer(), np.int32)] = True
            for part, x in zip(parts, (wide.view(np.int64).ravel(), own, hot)):
                part.append(x)
        keys, ids, hot = (np.concatenate(p) for p in parts)
        order = _by_key(keys, ids)
        keys, ids, hot = keys[order], ids[order], hot[order]
        hot = np.logical_or.reduceat(hot, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[new], ids[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        several = (sizes > 1) | hot
        if not several.any():
            return _GROUPED.empty_table()
        names, sizes, hot, ids = _thin_name(keys[first[several]], bucket), sizes[several], hot[several], ids[np.repeat(several, sizes)]
        first = np.cumsum(sizes) - sizes
        # Groups of the same members, found by several keys, count once; those of hot keys go by the key's name.
        names = np.where(hot, names, np.add.reduceat(mix(ids.view(U)), first).view(np.int64))
        once = np.zeros(len(first), bool)
        once[np.unique(names, return_index=True)[1]] = True
        ids, names, hot, sizes = ids[np.repeat(once, sizes)], names[once], hot[once], sizes[once]
        first = np.cumsum(sizes) - sizes
        small = (sizes <= PAIRED) & ~hot
        left = np.where(np.repeat(small, sizes), np.repeat(first + sizes, sizes) - np.arange(len(ids)), 0)
        at, rest = np.flatnonzero(left > 1), np.repeat(~small, sizes)
        hashes = mix(ids.view(U))
        heads = np.repeat(ids[hashes == np.repeat(np.minimum.reduceat(hashes, first), sizes)], sizes)
        pairs = [(ids[rest], heads[rest])]
        for step in range(1, PAIRED):
            at = at[left[at] > step]
            pairs.append((ids[at], ids[at + step]))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = a != b
        new[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        columns = [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.repeat(names, sizes)[rest])]), pa.array(np.concatenate([a, ids[rest]])), pa.concat_arrays([pa.array(b), pa.nulls(int(rest.sum()), pa.int64())])]
        return pa.table(columns, schema=_GROUPED)

    return run


def _near_clusters(starts: np.ndarray, marks: np.ndarray, whole: np.ndarray, near_marks: Near) -> tuple[np.ndarray, np.ndarray]:
    """For members of sorted groups: whether the marks of another are near, and a label that all members of a cluster of such neighbours share.

    ``whole`` groups, and those whose labels have not settled after ``PASSES``, are one cluster.
    """
    sizes = np.diff(np.append(starts, len(marks)))
    first, left = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes) - np.arange(len(marks))
    large = np.repeat(whole, sizes)
    near, label = large.copy(), np.where(large, first, np.arange(len(marks)))
    kept: list[tuple[np.ndarray, int]] | None = []

    def neighbours() -> Iterator[tuple[np.ndarray, int]]:
        at = np.flatnonzero(~large)
        for step in range(1, COMPARED):
            at = at[left[at] > step]
            if not len(at):
                break
            yield at[near_marks(marks[at], marks[at + step])], step

    for turn in range(PASSES):
        moved, held = np.zeros(len(marks), bool), 0
        for a, step in kept if turn and kept is not None else neighbours():
            if not turn and kept is not None:
                held += len(a)
                kept = [*kept, (a, step)] if held <= HELD else None
            b = a + step
            near[a] = near[b] = True
            least = np.minimum(label[a], label[b])
            moved[a[label[a] != least]] = moved[b[label[b] != least]] = True
            label[a], label[b] = least, least
        if not moved.any():
            break
    else:
        unsettled = np.isin(first, first[moved])
        label[unsettled] = first[unsettled]
    return near, label


def _central(marks: np.ndarray) -> int:
    """The item whose marks differ least from the majority of each bit: near copies of one text lie around it, often too far from each other to link."""
    bits = np.unpackbits(np.ascontiguousarray(marks).view(np.uint8).reshape(len(marks), -1), axis=1)
    return int((bits ^ (2 * bits.sum(0, dtype=np.int64) > len(bits))).sum(1).argmin())


def _grouped(buckets: int, near_marks: Near):
    """The candidates of a bucket: pairs (key null) of two ids, and the members (b null) of clusters too large to be listed in pairs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket >= buckets:
            names, ids = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table[c]]) for c in ("keys", "ids"))
            return pa.table([pa.array(names), pa.array(ids), pa.nulls(len(ids), pa.int64())], schema=_GROUPED)
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for k, i, m, r, h in zip(*(table[c] for c in ("keys", "ids", "marks", "refs", "hot"))):
            short = np.frombuffer(k.as_buffer(), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(short), 8), np.uint8)
            wide[:, :6] = short
            refs = np.frombuffer(r.as_buffer(), np.uint16 if len(r.as_buffer()) == 2 * len(short) else np.uint32)
            hot = np.zeros(len(short), bool)
            hot[np.frombuffer(h.as_buffer(), np.int32)] = True
            own = np.frombuffer(i.as_buffer(), np.int64)
            for part, x in zip(parts, (wide.view(np.int64).ravel(), own[refs], np.frombuffer(m.as_buffer(), U).reshape(len(own), -1)[refs], hot)):
                part.append(x)
        keys, ids, marks, hot = (np.concatenate(p) for p in parts)
        order = _by_key(keys, ids)
        keys, ids, marks, hot = keys[order], ids[order], marks[order], hot[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        hot_groups = np.logical_or.reduceat(hot, starts) if len(starts) else np.zeros(0, bool)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids, marks = keys[new], ids[new], marks[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        many = np.repeat((sizes > 1) | hot_groups, sizes)
        keys, ids, marks = keys[many], ids[many], marks[many]
        hot_groups = hot_groups[(sizes > 1) | hot_groups]
        if not len(keys):
            return _GROUPED.empty_table()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        near, label = _near_clusters(starts, marks, (sizes > COMPARED) | hot_groups, near_marks)
        keys, ids, marks, label, hot = keys[near], ids[near], marks[near], label[near], np.repeat(hot_groups, sizes)[near]
        order = np.argsort(label, kind="stable")
        keys, ids, marks, label, hot = keys[order], ids[order], marks[order], label[order], hot[order]
        first = np.flatnonzero(np.diff(label, prepend=-1))
        if not len(first):
            return _GROUPED.empty_table()
        # Clusters of the same members, found by several keys, count once; those of hot keys go by the key's name.
        sums = np.add.reduceat(mix(ids.view(U)), first).view(np.int64)
        sums = np.where(hot[first], _named(keys[first], bucket), sums)
        once = np.zeros(len(first), bool)
        once[np.unique(sums, return_index=True)[1]] = True
        sizes = np.diff(np.append(first, len(ids)))
        kept = np.repeat(once, sizes)
        ids, marks, hot, sums, sizes = ids[kept], marks[kept], hot[kept], sums[once], sizes[once]
        first = np.cumsum(sizes) - sizes
        small = (sizes <= PAIRED) & ~hot[first] if len(first) else np.zeros(0, bool)
        left = np.where(np.repeat(small, sizes), np.repeat(first + sizes, sizes) - np.arange(len(ids)), 0)
        at, pairs = np.flatnonzero(left > 1), []
        for step in range(1, PAIRED):
            at = at[left[at] > step]
            a = at[near_marks(marks[at], marks[at + step])]
            pairs.append((ids[a], ids[a + step]))
        rest = np.repeat(~small, sizes)
        head = np.repeat(first, sizes)
        for lo, n in zip(first[~small], sizes[~small]):
            head[lo : lo + n] = lo + _central(marks[lo : lo + n])
        rays = np.flatnonzero(rest & (head != np.arange(len(ids))))
        rays = rays[near_marks(marks[rays], marks[head[rays]])]
        pairs.append((ids[rays], ids[head[rays]]))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        columns = [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.repeat(sums, sizes)[rest])]), pa.array(np.concatenate([a, ids[rest]])), pa.concat_arrays([pa.array(b), pa.nulls(int(rest.sum()), pa.int64())])]
        return pa.table(columns, schema=_GROUPED)

    return run


def buckets_for(spark: SparkSession, keys: int) -> int:
    """How many buckets hold about ``BUCKET_KEYS`` keys each, at least one for each shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET_KEYS))


def candidates(packed: DataFrame, buckets: int, near_marks: Near) -> DataFrame:
    """(key, a, b) of ``packed`` rows: pairs with a null key, members ``a`` of large groups with a null ``b``."""
    return packed.groupBy("bucket").applyInArrow(_grouped(buckets, near_marks), GROUPED)


def thin_candidates(packed: DataFrame, buckets: int) -> DataFrame:
    """(key, a, b) as ``candidates`` gives, of the rows of ``ThinPacker``."""
    return packed.groupBy("bucket").applyInArrow(_thin_grouped(buckets), GROUPED)


def both_ends(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, value_a, value_b): for each pair what ``values(id, value)`` holds of its two items.

    ``pairs`` is counted; when there are few of them they are broadcast, so that only values of pairs are moved.
    """
    few = pairs.count() <= BROADCAST_IDS // 2
    side = F.broadcast(pairs) if few else pairs
    left, right = (values.join(side, values["id"] == side[x]).select("a", "b", F.col("value").alias(f"value_{x}")) for x in "ab")
    return left.join(right, ["a", "b"])


def apart(members: DataFrame, components: DataFrame) -> DataFrame:
    """(key, id, keys, c, parts) of ``members(key, id, keys)`` of groups whose members are in different components ``c``; parts tell how many a group is dealt to."""
    members = members.join(components.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "keys", F.coalesce("component", "id").alias("c"))
    ends = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high")
    return members.join(ends.select("key", F.expr(f"cast(n div {PART} + 1 AS int)").alias("parts")), "key").select("key", "id", "keys", "c", "parts")


def banded(members: DataFrame, facts: DataFrame, ratio: float) -> DataFrame:
    """``members`` with their ``facts`` and the band of their size: sizes of linked items differ by the factor ``ratio`` at most, so they are in one band or in two beside each other."""
    return members.join(facts, "id").withColumn("band", F.floor(F.ln(F.greatest("size", F.lit(1))) / float(-np.log(ratio))).cast("int"))


def star(members: DataFrame, near: Callable[[str, str], Column], bits: str) -> DataFrame:
    """For each id at most one pair (a, b): with the central item of a group and band, in another component and ``near``.

    The central item differs least, in the 64-bit column ``bits``, from the majority of each bit over the items of one band.
    """
    sums = [F.sum(F.expr(f"shiftright({bits}, {k}) & 1L")).alias(f"n{k}") for k in range(64)]
    most = " | ".join(f"CASE WHEN 2 * n{k} > n THEN shiftleft(1L, {k}) ELSE 0L END" for k in range(64))
    usual = members.groupBy("key", "band").agg(F.count("*").alias("n"), *sums).select("key", "band", F.expr(most).alias("usual"))
    heads = members.join(usual, ["key", "band"]).groupBy("key", "band").agg(F.min_by(F.struct(*members.columns), F.struct(F.expr(f"bit_count({bits} ^ usual)"), "id")).alias("h"))
    around = heads.select("key", F.explode(F.expr("sequence(band - 1, band + 1)")).alias("band"), "h")
    met = members.alias("y").join(around.alias("x"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("key", "band")] + [F.expr("y.c <> x.h.c"), near("x.h", "y")])
    return met.groupBy(F.col("y.id").alias("b")).agg(F.min("x.h.id").alias("a")).select("a", "b")


def meetings(members: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """All pairs (a, b) of ``members(key, id, keys, c, parts, band, ...)`` that share a key, are in different components and ``near`` (a test inside the join).

    An item meets those of its own band of sizes and of the next one. One side of
    a large group is dealt to parts, the other is copied to each of them. Of the keys that two items share only the least one makes
    their pair, where the items name their keys (``keys``).
    """
    one = members.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("above", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.expr("band - above"))
    once = F.expr("x.keys IS NULL OR y.keys IS NULL OR x.key = array_min(array_intersect(x.keys, y.keys))")
    pairs = one.alias("x").join(other.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("key", "part", "band")] + [F.expr("x.c <> y.c AND (y.above = 1 OR x.c < y.c)"), near("x", "y"), once])
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def across(members: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """The pairs of ``meetings``, those of items that name too many keys once as well."""
    return meetings(members, near).distinct()


def joined_by(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` after further ``links(a, b)``: these are contracted to components first."""
    of = {x: components.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"}
    ends = links.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = written(connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("to")), "merged")
    old = components.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = merged.join(components, merged["component"] == components["node"], "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    return written(old.unionByName(new), "components")


def linked(found: DataFrame, facts: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], ratio: float, bits: str = "s0") -> DataFrame:
    """(node, component) of the items that verified links join, from the candidates ``found(key, a, b)``.

    ``near`` builds, from the aliases of two rows of ``facts(id, size, ...)``, a cheap test that every link passes;
    ``verify`` keeps the pairs that link; ``ratio`` is the least that the sizes of linked items can have, ``bits`` a column of 64 bits in which linked items differ little.
    """
    pairs = written(found.where("key is null").select("a", "b").distinct(), "pairs")
    values = facts.select("id", F.struct(*(c for c in facts.columns if c != "id")).alias("value"))
    close = written(both_ends(pairs, values).where(near("value_a", "value_b")).select("a", "b"), "close")
    components = written(connected_components(verify(close)), "components")
    held = found.where("key is not null").groupBy(F.col("a").alias("id")).agg(F.collect_set("key").alias("keys"))
    members = written(held.select(F.explode("keys").alias("key"), "id", F.expr(f"CASE WHEN size(keys) <= {FEW_KEYS} THEN keys END").alias("keys")), "members")
    for step in ("star", "across") if members.limit(1).count() else ():
        left = written(banded(apart(members, components), facts, ratio), "left")
        if not left.limit(1).count():
            break
        links = written(verify(written(star(left, near, bits) if step == "star" else across(left, near), "pairs")), "links")
        if links.limit(1).count():
            components = joined_by(components, links)
    return components
