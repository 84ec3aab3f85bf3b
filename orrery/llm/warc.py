"""WARC archives written and read by Spark, with an index merged from sorted runs.

The records are text (UTF-8 payloads), so Spark's own text writer makes the
files wherever the session's file systems reach: a gzip member a file, records
ended by two CRLF. Each file read back gives a run of captures sorted by URL
key and timestamp. Range partitions take their part of every run and merge the
runs with a loser tree, which gives capture histories in global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint_dir, cut, delete, small, table

END = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of a file at most, by the bytes that a payload has at most: a file has about 1 GB before it is packed.
FILE_RECORDS = ((1 << 16, 16_384), (1 << 21, 512), (1 << 26, 16), (1 << 31, 1))
#: Captures of a merged range, about.
RANGE_ROWS = 500_000
#: The seconds over which capture times are spread: ten years.
SPAN = 315_360_000
CAPTURE = "url_key string, timestamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, run string, at long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, 20 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, body, digest, n)."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("body"))
    return rows.withColumns({"digest": base32_sha1(F.col("body").cast("binary")), "n": F.octet_length("body").cast("long")})


def shared_payloads(rows: DataFrame) -> DataFrame:
    """(digest, last) of the payloads that several rows have: the largest page_id, null if none is known."""
    return rows.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "last")


def records(rows: DataFrame, shared: DataFrame, epoch: int = 1_700_000_000, least: int = 0) -> DataFrame:
    """A column ``record`` with the whole text of each page's record, its file order left open.

    The table has no capture times: a page's is ``epoch`` plus its page_id in
    seconds, modulo SPAN. Of equal payloads of at least ``least`` bytes the
    largest page_id is the response, others revisit it. Rows that share it are
    all responses, and so are payloads of which no page_id is known. Payloads
    are not shuffled where the shared digests may be broadcast.
    """
    rows = rows.join(shared, "digest", "left")
    rows = rows.withColumn("revisits", F.coalesce((F.col("last") != F.col("id")) | (F.col("id").isNull() & F.col("last").isNotNull()), F.lit(False)) & (F.col("n") >= least))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    block = F.concat(http, F.when(F.col("revisits"), F.lit("")).otherwise(F.col("body")))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.date_format(F.timestamp_seconds(F.lit(epoch) + F.pmod(F.coalesce(F.col("id"), F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    refers = F.when(F.col("revisits"), F.concat(F.lit(f"WARC-Profile: {REVISIT}{END}WARC-Refers-To: "), name(F.col("last")), F.lit(END))).otherwise(F.lit(""))
    return rows.select(
        F.concat(
            F.lit(f"WARC/1.1{END}WARC-Type: "),
            F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response")),
            F.lit(f"{END}WARC-Record-ID: "),
            name(F.col("id")),
            F.lit(f"{END}WARC-Date: "),
            when,
            F.lit(f"{END}WARC-Target-URI: "),
            target,
            F.lit(f"{END}WARC-Payload-Digest: sha1:"),
            F.col("digest"),
            F.lit(END),
            refers,
            F.lit(f"Content-Type: application/http; msgtype=response{END}Content-Length: "),
            F.octet_length(block).cast("string"),
            F.lit(END + END),
            block,
        ).alias("record")
    )


def write(pages: DataFrame, path: str, epoch: int = 1_700_000_000, least: int = 0, **names) -> None:
    """Write the archives of ``pages`` under ``path``, larger payloads to files of fewer records."""
    rows = _rows(pages, **names)
    shared = small(cut(shared_payloads(rows)))
    largest = pages.select(F.max(F.octet_length(F.col(names.get("html", "html")).cast("string"))).alias("n")).head()["n"] or 0
    above = -1
    for most, held in FILE_RECORDS:
        some = rows.where((F.col("n") > above) & (F.col("n") <= most))
        records(some, shared, epoch, least).write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", held).text(path)
        above = most
        if largest <= most:
            break


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the top level down, then port, path and query; no scheme, www or fragment."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.split("#", 1)[0])
    host, slash, path = rest.partition("/")
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (slash or "/") + path.lower()


def captures(content: bytes) -> Iterator[tuple]:
    """(url_key, timestamp, page_id, type, refers_to, payload_bytes, digest, intact) of an archive's records, one record in memory at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                k, _, v = line.decode().partition(": ")
                head[k] = v
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {head['WARC-Record-ID']} has a wrong length")
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
            intact = revisit or len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
            number = lambda k: int(n) if (n := head.get(k, "")[10:-1]) else None
            yield url_key(head["WARC-Target-URI"]), head["WARC-Date"], number("WARC-Record-ID"), head["WARC-Type"], number("WARC-Refers-To"), size, digest, intact


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``, each file a run sorted by URL key, timestamp and page_id."""
    names = [x.split()[0] for x in CAPTURE.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = sorted(captures(content.as_py()), key=_order)
                if rows:
                    columns = [*zip(*rows, strict=True), [name] * len(rows), range(len(rows))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(read, CAPTURE)


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()]


class LoserTree:
    """Merges k sorted runs; each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key, self.k = sources, key, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at:
            if self.tree[at] < 0:
                self.tree[at] = winner
                return
            if self._beats(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (row := self.heads[i := self.tree[0]]) is not None:
            yield row
            self.heads[i] = next(self.sources[i], None)
            self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])
            self._play(i)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range by run and place -> in order. The range stays columnar; each run is read, and the result given, some rows at a time."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    rows = pa.Table.from_batches(kept)
    name, starts, seen = rows.column("run"), [0], 0
    for chunk in name.chunks:
        codes = chunk.dictionary_encode().indices.to_numpy()
        if seen and chunk[0].as_py() != name[seen - 1].as_py():
            starts.append(seen)
        starts += (np.flatnonzero(np.diff(codes)) + 1 + seen).tolist()
        seen += len(chunk)

    def read(start: int, end: int) -> Iterator[tuple]:
        for at in range(start, end, 1024):
            part = rows.slice(at, min(1024, end - at))
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    merged = iter(LoserTree([read(s, e) for s, e in zip(starts, [*starts[1:], rows.num_rows], strict=True)], _order))
    while some := list(itertools.islice(merged, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _TYPES, strict=True)], rows.schema.names)


def histories(found: DataFrame) -> DataFrame:
    """Captures in global order of URL key, timestamp and page_id: partitions are ranges in turn, each merged from the runs.

    A range is cut by all three, so the captures of one URL, however many, are
    dealt over tasks; there are as many ranges as keep each at some RANGE_ROWS.
    """
    ranges = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // RANGE_ROWS))
    parts = found.repartitionByRange(ranges, "url_key", "timestamp", "page_id").sortWithinPartitions("run", "at")
    return parts.mapInArrow(_merge, CAPTURE)


def archived(pages: DataFrame, **params) -> DataFrame:
    """Write ``pages`` to archives in the shared checkpoint folder, read them back, and give the ordered captures.

    One row per page, rows that share a page_id included. A null url or html is
    empty; a null page_id comes back as null; an empty table gives no rows;
    other columns are not read. The archives go once their captures are cut.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **params)
    found = cut(runs(spark, path))
    delete(spark, path)
    return histories(found)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archived(table(spark, sf_dir, "pages"))
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return rows.select("page_id", "payload_bytes", checked.cast("string").alias("payload_digest"), "record_type", "refers_to", "url_key", "timestamp")
