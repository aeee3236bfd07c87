"""Operator 6: WARC archives and their index, by an external index merge.

``write`` turns pages into WARC/1.1 records.  Of pages with equal payloads the one with the largest
id is a response with the payload, the others are revisits that refer to it.  The archives are
gzip files that Spark's own text writer puts into the shared store: a record's last line feed is
the writer's line separator, so a file is nothing but records, on any file system and with Spark's
commit protocol.  ``read_archives`` parses the files back into captures.

``merge_index`` orders captures by URL key (host reversed, as in SURT), timestamp and id.  Each
archive yields a run sorted in its task; runs are cut at splitters from a bounded sample and
exchanged by range, and a loser tree merges the runs of each range, so a URL captured very often
is split like any other.  The result carries each capture's place in the global order by range and
number, and in its URL's history inside the range.

Null payloads are empty payloads, null URLs the empty URL.  Rows with a null id are no captures and
are left out; rows that repeat an id are captures of their own.  A page's timestamp is
its id in seconds after the epoch, unless a timestamp column is named.  Only the named columns are
read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import checkpoint_dir, cut, partitions, sampled
from quire.llm.suffixes import LoserTree, common

#: Copies of a frequent payload's digest, so that its pages are dealt to so many tasks.
SALTS = 64
#: Captures in the sample for splitters at most.
SAMPLE = 20_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # a fixed value: the URL name space of RFC 4122


def record_id(page: int, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}/{row}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stamp(seconds: int) -> str:
    """A WARC date; beyond year 9999, and before 1, the ends of that span."""
    import datetime

    low, high = -62135596800, 253402300799
    moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=min(max(seconds, low), high))
    return f"{moment:%Y-%m-%dT%H:%M:%SZ}".rjust(20, "0")


def record(page: int, row: int, url: str, seconds: int, payload: bytes, refers: int | None) -> bytes:
    """One record: HTTP headers and payload, or for a revisit the headers alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers is None else b"")
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(page, row)),
        ("WARC-Date", stamp(seconds)),
        ("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-ID", str(page)),
    ]
    if refers is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers))]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of each record."""
    at = 0
    while at < len(raw):
        body = raw.index(b"\r\n\r\n", at) + 4
        lines = raw[at:body].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:] if line)
        past = body + int(fields["Content-Length"])
        if raw[past : past + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end")
        yield at, past + 4 - at, fields, raw[body:past]
        at = past + 4


def url_key(url: str) -> str:
    """The URL for sorting: scheme, user, port 80 or 443 and a www host label gone, host reversed."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host, question, query = host.partition("?")
    name, _, port = host.rpartition("@")[2].lower().partition(":")
    labels = name.split(".")
    labels = labels[1:] if labels[0] == "www" and len(labels) > 1 else labels
    return ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (question + query) + "/" + path


def with_originals(pages: DataFrame, page: str, url: str, html: str, timestamp: str | None) -> DataFrame:
    """Rows (page, row, url, seconds, payload, refers): refers is null for responses."""
    rows = pages.where(F.col(page).isNotNull()).select(
        F.col(page).cast("long").alias("page"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        (F.unix_seconds(F.col(timestamp)) if timestamp else F.col(page)).cast("long").alias("seconds"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("seconds", F.coalesce("seconds", F.lit(0)))
    # Counted before the shuffle, only of payloads that occur more than once, and copied per salt.
    many = rows.groupBy("digest").agg(F.count("*").alias("times"), F.max("page").alias("original")).where("times > 1").select("digest", "original")
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(many, ["digest", "salt"], "left")
    return joined.select("page", "url", "seconds", "payload", F.when(F.col("page") != F.col("original"), F.col("original")).alias("refers"))


def write(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html", timestamp: str | None = None) -> None:
    """Write the pages as gzip WARC files under ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            done = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, where, seconds, payload, refers = values
                done.append(record(name, row, where, seconds, payload, refers)[:-1])
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["record"])

    records = with_originals(pages, page, url, html, timestamp).mapInArrow(run, "record binary")
    # The cast keeps the bytes; the writer ends each record with the line feed that was left off.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (archive, offset, size, page, record_id, record_type, url, key, stamp, payload_bytes, payload_digest, refers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = zlib.decompress(content.as_py(), wbits=47)
                rows = []
                for at, size, fields, block in parse(raw):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    if fields["WARC-Type"] == "response" and (base32_sha1(payload) != told or len(payload) != length):
                        raise ValueError(f"damaged record at byte {at} of {path}")
                    refers = fields.get("X-Refers-To-Page")
                    uri = fields["WARC-Target-URI"]
                    rows.append((path, at, size, int(fields["X-Page-ID"]), fields["WARC-Record-ID"], fields["WARC-Type"], uri, url_key(uri), fields["WARC-Date"], length, told, None if refers is None else int(refers)))
                rows.sort(key=lambda r: (r[7], r[8], r[3]))  # the archive's own run
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, _SCHEMA)


_NAMES = ["archive", "offset", "size", "page", "record_id", "record_type", "url", "key", "stamp", "payload_bytes", "payload_digest", "refers"]
_SQL_KINDS = ["string", "long", "long", "long", "string", "string", "string", "string", "string", "long", "string", "long"]
_KINDS = [pa.int64() if k == "long" else pa.string() for k in _SQL_KINDS]
_SCHEMA = ", ".join(f"{n} {k}" for n, k in zip(_NAMES, _SQL_KINDS, strict=True))


def sort_bytes(key: str, when: str, page: int) -> bytes:
    """Bytes that sort as (key, timestamp, id); a key has no zero byte, being a URL's."""
    return key.encode("utf-8", "surrogatepass") + b"\0" + when.encode() + (page + (1 << 63)).to_bytes(8, "big")


def merge_index(captures: DataFrame) -> DataFrame:
    """The captures with (range, number, history): their global order, and their place in their URL's history of that range."""
    spark = captures.sparkSession
    seen = sorted(sort_bytes(r["key"], r["stamp"], r["page"]) for r in sampled(captures, SAMPLE, "key", "stamp", "page", "archive", "offset"))
    parts = partitions(spark)
    cuts = sorted({seen[len(seen) * k // parts] for k in range(1, parts)}) if seen else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            keys = [sort_bytes(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("key", "stamp", "page")), strict=True)]
            columns = [pa.array([bisect_right(cuts, k) for k in keys], pa.int64()), pa.array(keys, pa.binary()), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, ["range", "sort", *batch.schema.names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(runs: list[list[tuple]]) -> pa.RecordBatch:
            def run(rows: list[tuple]) -> Iterator[tuple]:
                before = b""
                for row in rows:
                    yield common(before, row[1], 0), row[1], row
                    before = row[1]

            done, history, last = [], 0, None
            for number, (_, _, row) in enumerate(LoserTree([run(r) for r in runs])):
                history = history + 1 if row[9] == last else 0
                last = row[9]
                done.append((row[0], number, history, *row[2:]))
            kinds = [pa.int64()] * 3 + _KINDS
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], ["range", "number", "history", *_NAMES])

        now, archive, runs = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if runs:
                        yield merged(runs)
                    now, archive, runs = row[0], None, []
                if row[2] != archive:
                    archive = row[2]
                    runs.append([])
                runs[-1].append(row)
        if runs:
            yield merged(runs)

    placed = captures.mapInArrow(place, f"range long, sort binary, {_SCHEMA}")
    dealt = placed.repartition("range").sortWithinPartitions("range", "archive", "sort")
    return dealt.mapInArrow(merge, f"range long, number long, history long, {_SCHEMA}")


def captured(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and merge their index."""
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    captures = cut(read_archives(spark, folder))
    # The index holds all that is asked for; the archives have been read.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return merge_index(captures)
