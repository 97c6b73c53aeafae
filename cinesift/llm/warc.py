"""WARC records and a Merkle fixity audit of their replicas."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import Scratch, materialize

#: Bytes of file that a leaf range covers, and children of a node.
RANGE, FANOUT = 1 << 16, 16
CRLF = "\r\n"


def record(url: Column, body: Column) -> Column:
    """A WARC response record, as bytes; null url or body is empty."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2))
    return F.concat(head, body, F.lit(CRLF * 2)).cast("binary")


def page_records(pages: DataFrame, per_file: int = 4096) -> DataFrame:
    """page_id, file, length, record: pages as records, those of `per_file` consecutive
    ids in one file. Pages without id are spread over 1,024 files of their own, numbered
    below 0, by a hash of what they hold. Null url or html is empty; repeated pages are
    repeated records; other columns are ignored."""
    rows = pages.select("page_id", "url", "html", record(F.col("url"), F.col("html")).alias("record"))
    file = F.coalesce(F.expr(f"page_id div {per_file}"), -1 - F.pmod(F.xxhash64("record"), F.lit(1024)))
    return rows.select("page_id", file.alias("file"), F.octet_length("record").cast("long").alias("length"), "record")


def placed(rows: DataFrame) -> DataFrame:
    """Rows (file, page_id, length, digest, ...) with the offset of each in its file,
    where records follow each other by page_id and digest. A file's rows are ordered in
    one task, so rows should not hold the records themselves."""
    order = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("offset", F.sum("length").over(order) - F.col("length"))


def from_pages(pages: DataFrame, per_file: int = 4096) -> DataFrame:
    """file, offset, length, page_id, record: page_records() with their offsets, to be
    written. An audit needs no bytes: placed() digests are enough for it."""
    rows = page_records(pages, per_file).withColumn("digest", F.sha2("record", 256))
    return placed(rows).select("page_id", "file", "record", "length", "offset")


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, header fields, body of the records of an uncompressed WARC
    file; what is no record is passed over up to the next one."""
    at = 0
    while m := _HEAD.search(data, at):
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in m[1].decode("utf-8", "replace").split(CRLF) if x)}
        size = int(fields.get("content-length", "0")) if fields.get("content-length", "0").isdigit() else 0
        end = m.end() + size
        after = end + 4 if data[end : end + 4] == b"\r\n\r\n" else end
        yield m.start(), after - m.start(), fields, data[m.end() : end]
        at = max(after, m.end())


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """offset, length, content of the members of a gzip file; what follows the last whole
    one is passed over."""
    at, view = 0, memoryview(data)
    while at < len(data):
        inflate, out, read = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof and read < len(data):
                out.append(inflate.decompress(view[read : read + (1 << 16)]))
                read = min(read + (1 << 16), len(data))
        except zlib.error:
            return
        if not inflate.eof:
            return
        end = read - len(inflate.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, url, record of every record under path, from plain files and
    from those with a gzip member for each record (.gz), where offset and length are of the
    member and record is its content.

    A file is read by one task, as the bytes of one cell (Spark allows 2 GB). What is no
    record is passed over; a record without a target has a null url. Empty files: no rows.
    """
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("record", pa.binary())])

    def records(file, data):
        if file.endswith(".gz"):
            for at, n, body in members(data):
                for _, _, fields, _ in itertools.islice(parse(body), 1):
                    yield file, at, n, fields.get("warc-target-uri"), body
        else:
            for at, n, fields, _ in parse(data):
                yield file, at, n, fields.get("warc-target-uri"), data[at : at + n]

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = records(file, data)
                while part := list(itertools.islice(rows, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, length long, url string, record binary")


def leaves(records: DataFrame) -> DataFrame:
    """The records without their bytes, and the SHA-256 of those; null records have a null
    digest. Rows that have a digest and no record stay as they are."""
    return records.withColumn("digest", F.sha2("record", 256)).drop("record") if "record" in records.columns else records


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """file, node, digest for each level, from ranges of RANGE bytes upwards. A node's
    digest is of its children's, in order; it has at most FANOUT, or the records that
    begin in its range. Records at one offset are in the order of their digests; null
    digests read as empty. No rows: levels without rows."""
    out, rows = [], leaf.select("file", F.expr(f"offset div {RANGE}").alias("node"), F.col("offset").alias("at"), "digest")
    for _ in range(levels):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: F.concat_ws(":", x["at"].cast("string"), F.coalesce(x["digest"], F.lit("")))), ",")
        level = rows.groupBy("file", "node").agg(F.sha2(children.cast("binary"), 256).alias("digest"))
        out.append(level)
        rows = level.select("file", F.expr(f"node div {FANOUT}").alias("node"), F.col("node").alias("at"), "digest")
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """What differs between two replicas: file, offset, status of records that are
    corrupt (other bytes at the offset in b), missing (in b) or extra (not in a).

    a, b: leaves(). Roots are compared first; from there, only nodes below
    differing ones are looked at, level by level, down to the records. Equal
    replicas end at their roots. Repeated rows at one offset are compared as the
    sorted list of their digests. Null file: a file of that name. Rows without
    offset aren't in any range and are ignored. No rows: no rows.
    """
    side = lambda x: x.where("offset is not null").select(F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), F.col("offset").cast("long").alias("offset"), F.coalesce("digest", F.lit("")).alias("digest"))
    a, b = side(a), side(b)
    end = a.select("offset").union(b.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = 1
    while RANGE * FANOUT ** (levels - 1) <= end:
        levels += 1
    with Scratch(a.sparkSession) as scratch:
        trees = [[scratch.keep(level, "merkle") for level in tree(x, levels)] for x in (a, b)]
        bad = None
        for k in reversed(range(levels)):
            pair = []
            for t, name in zip(trees, ("here", "there"), strict=True):
                level = t[k].withColumnRenamed("digest", name)
                if bad is not None:  # only below what differs
                    level = level.withColumn("up", F.expr(f"node div {FANOUT}")).join(bad, ["file", "up"], "left_semi").drop("up")
                pair.append(level)
            differ = pair[0].join(pair[1], ["file", "node"], "full").where(~F.col("here").eqNullSafe(F.col("there")))
            bad = scratch.keep(differ.select("file", F.col("node").alias("up")), "differing")
        pair = []
        for x, name in ((a, "here"), (b, "there")):
            below = x.withColumn("up", F.expr(f"offset div {RANGE}")).join(bad, ["file", "up"], "left_semi")
            pair.append(below.groupBy("file", "offset").agg(F.array_sort(F.collect_list("digest")).alias(name)))
        both = pair[0].join(pair[1], ["file", "offset"], "full").where(~F.col("here").eqNullSafe(F.col("there")))
        status = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("corrupt")
        return scratch.result(both.select("file", "offset", status.alias("status")), "damage")


def fixity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every record of replica a with its digest and status: ok, corrupt or missing in b;
    and a row for each offset that only b has (extra). Records of a without offset are
    compared with nothing: unchecked.

    a, b: file, offset and either record or digest; other columns of a stay, but one named
    status is replaced. Null records are equal to each other. Repeated rows at one offset
    share its status. No rows: no rows.
    """
    a, b = (materialize(leaves(x), "leaves") if "record" in x.columns else x for x in (a, b))
    found = audit(a, b).select(F.col("file").alias("_name"), F.col("offset").alias("_at"), F.col("status").alias("_found"))
    rows = a.drop("status").join(found, F.coalesce(a["file"].cast("string"), F.lit("")).eqNullSafe(F.col("_name")) & (a["offset"] == F.col("_at")), "full")
    extra = F.col("_found") == "extra"
    file = F.when(extra, F.col("_name").cast(a.schema["file"].dataType)).otherwise(F.col("file"))
    status = F.coalesce("_found", F.when(F.col("offset").isNull(), "unchecked").otherwise("ok"))
    return rows.withColumns({"status": status, "file": file, "offset": F.coalesce("offset", "_at")}).drop("_name", "_at", "_found")
