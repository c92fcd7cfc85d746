"""WARC archives with a two-level capture index (operator 4).

Archives are real gzip-per-record WARC files. They are written by Spark's text sink, so they land in any file system that
Spark can write: a row is the bytes of one gzip member, and the line separator is an empty member, which readers skip.
Of records with equal payloads the one with the largest page id is the response; the others are revisit records that
refer to it and carry no body.

The index has two levels. Captures are sorted by reversed-host URL key (range partitioning, then sorting inside), and every
`lines` of them are one compressed block; blocks lie one after another in index files written the same way. The sparse directory is a
table beside them, with first and last key, file, offset and length of each block. A look-up searches the directory by bisection for
the blocks that may hold a key, reads only those ranges, searches inside, and reads only the ranges of the records it wants.
Many keys are looked up at once by tasks: sorted keys meet the slice of the directory between the least and the greatest of a
batch, and every block that is hit is read once, wherever its keys were searched, so a key that a third of all captures share is
read by many tasks.

Tasks read archives and ranges through Arrow's file systems, as streams; no file is held whole.

Defined results: null html is an empty payload; very long html is one record like any other; a null page id is left out of the
record and read back as null, and never is the largest; rows that share the largest id are all responses; if no id of a group is
known, all are responses; null URLs have an empty key; repeated rows give repeated records; an empty table gives an empty one.
Other columns play no part.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import map_arrow, new_path, written

# Fixed value: a gzip member that holds nothing.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
DATE = "1970-01-01T00:00:00Z"  # captures carry no date of their own
FEED, READ = 1 << 14, 1 << 20
FILE_BYTES = 64 << 20  # payload of an archive file, about


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member, with no time in its header."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(read: Callable[[], bytes], at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each member that holds something. read: gives the next bytes of a stream, none at its end."""
    view, i, z, out, used = memoryview(b""), 0, None, [], 0
    while True:
        if i == len(view):
            view, i = memoryview(read()), 0
            if not len(view):
                break
        if z is None:
            z, out, used = zlib.decompressobj(31), [], 0
        feed = view[i : i + FEED]
        out.append(z.decompress(feed))
        taken = len(feed) - len(z.unused_data)
        i, used = i + taken, used + taken
        if z.eof:
            if body := b"".join(out):
                yield at, used, body
            at, z = at + used, None
    if z is not None:
        raise ValueError("a gzip member is cut off")


def opened(path: str):
    """A file for reading in a task, through Arrow's file systems."""
    system, name = located(path)
    return system.open_input_file(name)


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def block_at(path: str, offset: int, length: int) -> bytes:
    """The content of the one member in a range of a file."""
    with opened(path) as f:
        f.seek(offset)
        rest = iter([f.read(length), b""])
    ((_, _, body),) = members(lambda: next(rest))
    return body


def surt(url: str | None) -> str:
    """Reversed-host key: scheme and www dropped, lower-case host by labels from the last, then port, path and query."""
    rest = (url or "").strip()
    if "://" in rest:
        rest = rest.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:].split("#", 1)[0]
    host, _, port = host.partition(":")
    host = host.removeprefix("www.")
    if not host and not path:
        return ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (path or "/")


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode().rstrip("=")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """The bytes of one WARC record. A response carries a minimal HTTP head and the payload; a revisit the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    name = hashlib.sha1(f"{page_id}|{url}|{digest}|{kind}".encode()).hexdigest()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:sha1:{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-case names), HTTP head and payload of one record; raises ValueError if it does not hold together."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return {"fields": fields, "http": http, "payload": payload}


def write_binary(df: DataFrame, column: str, path: str, rows_per_file: int) -> None:
    """Writes the bytes of a column one after another, with empty members between, through Spark's text sink."""
    df.select(F.col(column).cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", rows_per_file).option("compression", "none").text(path)


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, rows_per_file: int | None = None) -> None:
    """Writes a record for every row. Only payloads that occur more than once are joined back, as digests. Files are cut by rows, so
    many that the mean file has FILE_BYTES of payload."""
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    many = rows.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("winner")).filter(f"n > 1 AND winner IS NOT NULL").select("sha", "winner")
    if rows_per_file is None:
        mean = rows.agg(F.avg(F.length("payload"))).first()[0] or 0
        rows_per_file = int(max(16, min(20_000, FILE_BYTES // (mean + 256))))
    known = rows.join(many, "sha", "left").withColumn("revisit", (F.length("payload") >= least_bytes) & F.coalesce(F.col("winner") != F.coalesce("page_id", F.col("winner") - 1), F.lit(False)))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 512):
                out = []
                for p, u, body, sha, w, r in zip(*(c.to_pylist() for c in b.slice(k, 512).columns)):
                    out.append(member(record(p, u, body, digest_text(sha), "revisit" if r else "response", w if r else None)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    write_binary(map_arrow(known.select("page_id", "url", "payload", "sha", "winner", "revisit"), run, "member binary"), "member", path, rows_per_file)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back: one row per record, with where it lies. Digests and lengths of responses are those of the
    payload that was read, and a digest that its record does not declare is an error. A revisit has what it declares."""

    def batch(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], CAPTURE)

    def run(batches):
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            rows = []
            with opened(name) as stream:
                for at, size, body in members(lambda: stream.read(READ)):
                    r = parse(body)
                    f, kind = r["fields"], r["fields"]["warc-type"]
                    said = f["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest_text(hashlib.sha1(r["payload"]).digest()) != said:
                        raise ValueError(f"digest differs at {at} of {name}")
                    n = len(r["payload"]) if kind == "response" else int(f["x-payload-length"])
                    number = lambda k: int(f[k]) if k in f else None
                    rows.append((surt(f.get("warc-target-uri")), number("x-page-id"), n, said, kind, number("x-refers-to-page-id"), name, at, size))
                    if len(rows) == 4096:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path")
    return map_arrow(files, run, CAPTURE_SCHEMA)


CAPTURE = ["key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"]
CAPTURE_SCHEMA = "key string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"


def write_index(found: DataFrame, path: str, lines: int = 1000, blocks_per_file: int = 64) -> None:
    """Sorts captures by key and writes them as blocks of `lines` JSON lines, one gzip member a block, and the directory of the
    blocks as a table beside them."""

    def run(batches):
        held: list[bytes] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(json.dumps(row, ensure_ascii=False).encode("utf-8"))
                if len(held) == lines:
                    yield pa.RecordBatch.from_arrays([pa.array([member(b"\n".join(held), 6)], pa.binary())], ["block"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([member(b"\n".join(held), 6)], pa.binary())], ["block"])

    order = ["key", "page_id", "file", "offset"]
    sorted_rows = found.select(*CAPTURE).repartitionByRange(*order).sortWithinPartitions(*order)
    write_binary(map_arrow(sorted_rows, run, "block binary"), "block", path, blocks_per_file)
    blocks = directory_of(found.sparkSession, path)
    blocks.repartitionByRange("first", "last", "file", "offset").sortWithinPartitions("first", "last", "file", "offset").write.parquet(path + DIRECTORY)


DIRECTORY = "-directory"  # what the name of the directory adds to that of the index


def directory_of(spark: SparkSession, path: str) -> DataFrame:
    """first, last, file, offset, length, captures: one row for each block of the index files."""

    def run(batches):
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            rows = []
            with opened(name) as stream:
                for at, size, body in members(lambda: stream.read(READ)):
                    entries = body.split(b"\n")
                    rows.append((json.loads(entries[0])[0], json.loads(entries[-1])[0], name, at, size, len(entries)))
            if rows:
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["first", "last", "file", "offset", "length", "captures"])

    return map_arrow(spark.read.format("binaryFile").load(path).select("path"), run, "first string, last string, file string, offset bigint, length bigint, captures bigint")


def blocks_of(keys: list[str], firsts: list[str], lasts: list[str]) -> Iterator[tuple[str, int]]:
    """(key, place) of every block that may hold a key; blocks are in order of their keys."""
    for key in keys:
        i = bisect.bisect_left(lasts, key)
        while i < len(firsts) and firsts[i] <= key:
            yield key, i
            i += 1


def keys_of(df: DataFrame, url_col: str) -> DataFrame:
    """The distinct keys of the URLs of a table."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({surt(u) for u in b.column(0).to_pylist()}), pa.string())], ["key"])

    return map_arrow(df.select(url_col), run, "key string").distinct()


def looked_up(keys: DataFrame, path: str) -> DataFrame:
    """All captures of an index whose key is among keys (distinct), by the directory and range reads."""

    def search(batches):
        system, name = located(path + DIRECTORY)
        table = ds.dataset(name, filesystem=system, format="parquet")
        for b in batches:
            own = sorted(b.column(0).to_pylist())
            if not own:
                continue
            part = table.to_table(filter=(ds.field("last") >= own[0]) & (ds.field("first") <= own[-1])).sort_by([(c, "ascending") for c in ("last", "first", "file", "offset")])
            cols = part.to_pydict()
            hits = list(blocks_of(own, cols["first"], cols["last"]))
            for k in range(0, len(hits), 1 << 16):
                at = hits[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in at], pa.string()), *(pa.array([cols[c][i] for _, i in at], t) for c, t in (("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())))], ["key", "file", "offset", "length"])

    def fetch(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            for file, offset, length, want in zip(*(c.to_pylist() for c in b.columns)):
                rows, out = [json.loads(x) for x in block_at(file, offset, length).split(b"\n")], []
                for key in sorted(want):
                    lo = bisect.bisect_left(rows, key, key=lambda r: r[0])
                    while lo < len(rows) and rows[lo][0] == key:
                        out.append(rows[lo])
                        lo += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], CAPTURE)

    hits = map_arrow(keys.repartitionByRange("key").sortWithinPartitions("key"), search, "key string, file string, offset bigint, length bigint")
    blocks = hits.groupBy("file", "offset", "length").agg(F.collect_set("key").alias("keys"))  # at most as many as a block has captures
    return map_arrow(blocks, fetch, CAPTURE_SCHEMA)


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes of a file in whatever file system it lies, without reading the rest."""
    p = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


class Lookup:
    """Look-ups of single URLs by the driver: the rows of the directory that may hold the key, then range reads."""

    def __init__(self, spark: SparkSession, index_path: str):
        self.spark = spark
        self.directory = spark.read.parquet(index_path + DIRECTORY)

    def member_at(self, file: str, offset: int, length: int) -> bytes:
        rest = iter([read_range(self.spark, file, offset, length), b""])
        return next(members(lambda: next(rest)))[2]

    def captures(self, url: str) -> list[dict]:
        key, out = surt(url), []
        for b in self.directory.filter((F.col("last") >= key) & (F.col("first") <= key)).orderBy("last", "first", "file", "offset").toLocalIterator():
            rows = [json.loads(x) for x in self.member_at(b["file"], b["offset"], b["length"]).split(b"\n")]
            lo = bisect.bisect_left(rows, key, key=lambda r: r[0])
            while lo < len(rows) and rows[lo][0] == key:
                out.append(dict(zip(CAPTURE, rows[lo])))
                lo += 1
        return out

    def payloads(self, url: str) -> list[bytes]:
        """Payloads of the captures that are responses, by range reads of their records."""
        return [parse(self.member_at(c["file"], c["offset"], c["length"]))["payload"] for c in self.captures(url) if c["record_type"] == "response"]


def archived(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes archives, reads them back into an index, looks the URL of every row up in it, and returns what was found. Length and
    digest of a revisit are those that were read of the response it refers to; a revisit without one is an error."""
    spark = df.sparkSession
    archives, index = new_path(spark, "warc"), new_path(spark, "warc-index")
    write_archives(df, archives, id_col, url_col, html_col, least_bytes)
    # a null URL and the URL of a record without one have the same key, so do lines that were broken for the header
    write_index(captures(spark, archives), index)
    urls = df.select(F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"))
    found, _ = written(spark, looked_up(keys_of(urls, "url"), index), "warc-found")
    responses = found.filter("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest")).agg(F.max("payload_bytes").alias("r_bytes"))
    responses, _ = written(spark, responses, "warc-responses")
    met = found.filter("record_type = 'revisit'").join(responses, (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    lost = F.raise_error(F.concat(F.lit("no response for revisit "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))).cast("long")
    same = F.col("r_bytes") == F.col("payload_bytes")
    revisits = met.withColumn("payload_bytes", F.when(same, F.col("r_bytes")).otherwise(lost)).select(*CAPTURE)
    return found.filter("record_type = 'response'").select(*CAPTURE).unionByName(revisits)
