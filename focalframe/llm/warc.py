"""WARC archives of captures, read back, and a merged index of them.

Writing: payloads are digested in SQL; of equal payloads the one of the largest id is stored as a response, the others become
revisits that name it. Records are text (payloads are UTF-8), so Spark's text writer puts them down, with the blank line
that ends a record as line separator, gzipped, in any file system and under its commit protocol.

Reading: the files' parts between blank lines come back in order; a parser per file joins them again and cuts records by
Content-Length alone, so payloads may contain anything. Digests are computed anew and compared.

Index: each reading task writes its captures as a run sorted by (URL key, time, id, file, offset). Ranges of that order, with bounds
taken from all runs, are then merged by k-way loser trees, one task a range, into one globally ordered index, which
holds all of a capture but its payload.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, scratch_path, written

END = "\r\n\r\n"
#: Captures in a merge range, about.
RANGE_ROWS = 50_000
#: The digits of base 32 as conv() writes them and as RFC 4648 does.
CONV32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: str) -> Column:
    """The bare upper-case base-32 SHA-1 of a string column's UTF-8 bytes, five bytes (eight digits) at a time."""
    parts = [f"lpad(conv(substr(sha1(encode({text}, 'UTF-8')), {1 + 10 * i}, 10), 16, 32), 8, '0')" for i in range(4)]
    return F.expr(f"translate(concat({', '.join(parts)}), '{CONV32}', '{RFC32}')")


def url_key(url: str = "url") -> Column:
    """A sortable key: the host's labels from the last to the first, a bracket, then the lower-cased rest; the whole url where it has no host."""
    host = f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
    rest = f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1))"
    return F.expr(f"CASE WHEN {url} IS NULL THEN '' WHEN {host} = '' THEN lower({url}) ELSE concat(array_join(reverse(split({host}, '[.]')), ','), ')', {rest}) END")


def records(pages: DataFrame, least_bytes: int = 0, start: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): the text of one WARC record per row of ``pages(page_id, url, html)``."""
    body = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", base32_sha1("html"))
    body = body.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("url", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", ""))
    ids = written(body.select("page_id", "digest", "bytes"), "digests")
    last = ids.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    last = written(last, "copies")
    few = last.count() <= BROADCAST_IDS // 2
    body = body.join(F.broadcast(last) if few else last, "digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = "concat('<urn:capture:', coalesce(cast({} AS string), ''), '>')"
    when = F.date_format(F.to_timestamp(F.lit(start)) + F.make_interval(secs=F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.expr(name.format("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), F.expr(name.format("first_id")))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nX-Payload-Length: "), F.col("bytes").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
    )
    return body.select("page_id", F.concat(head, F.lit(END), F.when(revisit, "").otherwise(F.col("html"))).alias("record"))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """Writes gzipped WARC files to ``path``, one for each partition of ``pages``."""
    records(pages, **options).select("record").write.option("lineSep", END).option("compression", "gzip").text(path)


class Stream:
    """The bytes of one file, pushed in the parts that lie between blank lines."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.need, self.offset = 0, 1, 0

    def push(self, part: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(offset, headers, payload) of the records whose payload ends in what was pushed so far."""
        end = END.encode()
        self.parts += [end, part] if self.parts else [part]
        self.size += len(part) + (len(end) if len(self.parts) > 1 else 0)
        if self.size < self.need:
            return
        data, at = b"".join(self.parts), 0
        while True:
            start = at + (len(end) if self.offset else 0)
            cut = data.find(end, start)
            if cut < 0:
                self.need = self.size - at + 1
                break
            lines = data[start:cut].decode().split("\r\n")
            if lines[0] != "WARC/1.0":
                raise ValueError(f"no WARC record at byte {self.offset}")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            stop = cut + len(end) + int(headers["Content-Length"])
            if stop > len(data):
                self.need = stop - at
                break
            yield self.offset + start - at, headers, data[cut + len(end) : stop]
            self.offset += stop - at
            at = stop
        self.parts, self.size = [data[at:]], len(data) - at


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("file", "offset", "record_id", "url", "date", "record_type", "digest", "refers_to", "length", "html")
    file, stream, rows, size = None, Stream(), [], 0
    for batch in batches:
        for path, value in zip(batch.column(0), batch.column(1)):
            path = path.as_py()
            if path != file:
                file, stream = path, Stream()
            for offset, h, payload in stream.push(value.as_buffer().to_pybytes()):
                kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{file}: the payload at byte {offset} does not have its digest")
                length = int(h.get("X-Payload-Length", len(payload)))
                rows.append((file, offset, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"], kind, digest, h.get("WARC-Refers-To"), length, None if kind == "revisit" else payload.decode()))
                size += len(payload)
                if size > 4_000_000 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_SCHEMA)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_SCHEMA)


_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("length", pa.int64()), ("html", pa.string())])
_DDL = "file string, offset long, record_id string, url string, date string, record_type string, digest string, refers_to string, length long, html string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in ``path``; response payloads are checked against their digests; html is null for revisits."""
    text = spark.read.option("lineSep", END).text(path)
    return text.select(F.col("_metadata.file_path"), F.col("value").cast("binary")).mapInArrow(_parsed, _DDL)


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so each step plays one path of log k matches."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


ORDER = ("url_key", "date", "page", "file", "offset")


def ascending(table: pa.Table) -> list[tuple[int, int]]:
    """The spans of a run's rows that are in order: one, unless the shuffle brought parts of the run out of turn."""
    keys = list(zip(*(table[c].to_pylist() if c != "page" else [-1 << 63 if x is None else x for x in table[c].to_pylist()] for c in ORDER)))
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _items(table: pa.Table, start: int, end: int, base: int) -> Iterator[tuple]:
    """(keys of the order, row number) one after another, converted a thousand rows at a time."""
    for at in range(start, end, 1000):
        part = table.slice(at, min(1000, end - at))
        columns = [part[c].to_pylist() for c in ORDER]
        columns[2] = [-1 << 63 if x is None else x for x in columns[2]]
        for k, row in enumerate(zip(*columns)):
            yield (*row, base + at + k)


def _merged(schema: pa.Schema):
    """Each task's rows: slices of runs, each in order; the merged rows and their place in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            which = batch.column(0).to_numpy()
            for r in sorted(set(which.tolist())):
                slices.setdefault(r, []).append(batch.filter(pa.array(which == r)))
        tables = [pa.Table.from_batches(slices[r]) for r in sorted(slices)]
        runs, total = [], 0
        for t in tables:
            runs += [_items(t, a, b, total) for a, b in ascending(t)]
            total += t.num_rows
        if not total:
            return
        order = [item[-1] for item in LoserTree(runs)]
        merged = pa.concat_tables(tables).take(pa.array(order))
        merged = merged.append_column("place", pa.array(range(total), pa.int64()))
        yield from merged.select(schema.names).to_batches(max_chunksize=10_000)

    return run


def merge_index(runs: DataFrame) -> DataFrame:
    """(range, place, position, url_key, date, page, file, offset, ...): the captures of ``runs(run, ...)`` in global order; ``position`` numbers them from 0.

    Each run is in order by ``ORDER``. Rows go to ranges of that order, so a hot key spreads over many ranges;
    a task holds one range of about ``RANGE_ROWS`` rows. Merged ranges are written once, then numbered through.
    """
    ranges = max(1, int(runs.count() // RANGE_ROWS) + 1, runs.sparkSession.sparkContext.defaultParallelism)
    dealt = runs.withColumn("run", F.xxhash64("run", F.spark_partition_id())).repartitionByRange(ranges, *ORDER)
    schema = runs.drop("run").withColumn("place", F.lit(0).cast("long")).schema
    arrow = pa.schema([(f.name, {"long": pa.int64(), "string": pa.string()}[f.dataType.typeName()]) for f in schema])
    merged = written(dealt.mapInArrow(_merged(arrow), schema).withColumn("range", F.spark_partition_id()), "merged")
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("range", before.alias("base"))
    return merged.join(F.broadcast(bases), "range").withColumn("position", F.col("base") + F.col("place")).drop("base")


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Writes archives of ``pages``, reads them back; (captures, index).

    Captures: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, file, offset, html (of responses). The index has
    the same rows without url and html, with url_key, in the global order of ``ORDER``, numbered by ``position``. A
    null html is an empty payload, a null url an empty one. Payloads of fewer than ``least_bytes`` bytes never refer. A null
    page_id is written and read back as null, comes first among equal keys, and is never referred to unless no other row has its payload. Rows with equal ids and
    payloads are one capture each; none refers to the other. Payloads of any length are whole. Line breaks in urls are taken out. No pages give no records.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    write_archives(plain, path, least_bytes=least_bytes)
    number = "cast(nullif(regexp_extract({}, '<urn:capture:(-?[0-9]*)>', 1), '') AS bigint)"
    captures = read_archives(spark, path).select(
        F.expr(number.format("record_id")).alias("page_id"),
        F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.expr(number.format("refers_to"))).alias("refers_to"),
        "url",
        "date",
        F.element_at(F.split("file", "/"), -1).alias("file"),
        "offset",
        "html",
    )
    runs = captures.select(F.spark_partition_id().cast("long").alias("run"), url_key().alias("url_key"), "date", F.col("page_id").alias("page"), "file", "offset", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return captures, merge_index(written(runs.sortWithinPartitions(*ORDER), "runs"))
