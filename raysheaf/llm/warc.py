"""WARC archives of pages, and an index of their captures by external merge.

Writing: a record is the text of its header and payload. Each task writes files of about ``FILE_BYTES``, every record a gzip
member of its own, so an offset of the index can be sought and read alone. What tasks have written counts once their rows are in
the manifest, a table that Spark commits; files of tasks that were lost or run twice aren't in it and aren't read.

Reading: a file is read as a stream and cut by Content-Length; payload digests are computed from what was read.

Index: the captures of one archive, sorted, make a run. Runs are dealt out by ranges of (URL key, timestamp, page id), so a URL
with any number of captures is spread over ranges, and each range merges its pieces of the runs with a loser tree. Runs beyond
``MEMORY_ROWS`` rows of a range are merged first into longer ones that wait in the shared folder until the last merge.

Archives and waiting runs are written and read by the tasks with pyarrow's file systems (local, s3, gs, abfs, hdfs).
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import lean, materialise, scratch_path

BREAK = "\r\n\r\n"
FILE_BYTES = 256 << 20  # of an archive, compressed; a record that begins below it is written whole
RANGE_ROWS = 200_000  # rows of a range of the index, about
MEMORY_ROWS = 500_000  # rows that a merging task holds at once
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: RFC 4648
EPOCH = 1_704_067_200  # 2024-01-01, the date of page 0
SPAN = 100 * 31_557_600  # seconds after that in which pages without a date are dated
INDEX = (
    "page_id long, url_key string, ts string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "file string, offset long, length long"
)
ENTRY = tuple(f.split()[0] for f in INDEX.split(", "))


def base32(hex_digest: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal: 5 hexadecimal digits make 4 of base 32."""
    digits = []
    for group in range(8):
        value = F.conv(F.substring(hex_digest, 5 * group + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(value, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*digits)


def url_key(url: str) -> str:
    """Host labels reversed, then the path and query in lower case: ``com,example)/a?b``. Without a host: the text in lower case."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        host = ""
    if not host:
        return url.strip().lower()
    host = ",".join(reversed(host.lower().removeprefix("www.").split(".")))
    return f"{host}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def _dated(page_id: Column, date: Column | None) -> Column:
    """A WARC date, always of the same width: years have four digits."""
    own = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(page_id.cast("long"), F.lit(0)), F.lit(SPAN)))
    if date is not None:
        first, last = (F.timestamp_seconds(F.lit(s)) for s in (-30_610_224_000, 253_402_300_799))  # of the years 1000 and 9999
        own = F.coalesce(F.least(F.greatest(date.cast("timestamp"), first), last), own)
    return F.date_format(own, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, least: int = 0, date_col: str | None = None) -> DataFrame:
    """One row per page: page_id, record (header and payload; the blank lines that follow are added on writing).

    A page_id is a whole number, any of 64 bits; other types are an error. A page's date is that of ``date_col`` (between the years 1000 and
    9999), or where there is none one that follows from its id: so many seconds after an epoch, starting again after ``SPAN``.

    Of equal payloads of at least ``least`` bytes the smallest page_id is a response and the others are revisits of it, without
    a body; smaller payloads are responses. Equal payloads are grouped by SHA-256, SHA-1 and length. Null html is empty, a null
    URL is ``urn:x-page:`` and the id. Rows that repeat a page_id and its html are responses each.
    """
    if not isinstance(pages.schema["page_id"].dataType, T.IntegralType):
        raise ValueError("a page_id has to be a whole number")
    date = _dated(F.col("page_id"), F.col(date_col) if date_col else None)
    body = pages.select(date.alias("stamp"), "page_id", F.coalesce("url", F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sized = body.withColumns({"bytes": F.octet_length("html").cast("long"), "sha1": F.sha1(F.encode("html", "UTF-8")), "sha256": F.unhex(F.sha2("html", 256))})
    seen = sized.where(F.col("bytes") >= least).groupBy("sha256", "sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    seen = seen.where("n > 1").select(F.col("sha256").alias("d256"), F.col("sha1").alias("d1"), F.col("bytes").alias("d_bytes"), "first")
    seen = materialise(seen, "payloads")  # so that the join reads both sides from a shuffle and AQE can split a hot payload
    marked = sized.join(seen, (F.col("sha256") == F.col("d256")) & (F.col("sha1") == F.col("d1")) & (F.col("bytes") == F.col("d_bytes")), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    uri = F.regexp_replace("url", "[\\r\\n]+", " ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Date: "), F.col("stamp")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:x-page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(again, F.concat(F.lit("WARC-Refers-To-Payload-Length: "), F.col("bytes").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return marked.select("page_id", F.concat(F.concat_ws("\r\n", *lines), F.lit(BREAK), F.when(again, "").otherwise(F.col("html"))).alias("record"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    if "://" in path:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), path.removeprefix("file:")


def write_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES, date_col: str | None = None) -> str:
    """Write ``records`` to gzipped WARC files below ``path``, and the table ``manifest`` of them; returns ``path``."""
    spark = pages.sparkSession
    rows = records(pages, least, date_col).select("record")

    def run(batches):
        store, folder = _store(path)
        out, name, n, size = None, None, 0, 0

        def entry():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for batch in batches:
            for record in batch.column(0):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    name, n, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                for part in (zipped.compress(record.as_py().encode()), zipped.compress(BREAK.encode()), zipped.flush()):
                    out.write(part)
                    size += len(part)
                n += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield entry()
        if out is not None:
            out.close()
            yield entry()

    rows.mapInArrow(lean(run), "file string, records long, bytes long").write.parquet(f"{path}/manifest")
    return path


class _Unpacked:
    """The bytes of a gzip file, unpacked as they are asked for; plain bytes are passed on.

    ``read(n)`` gives the file's next bytes. ``starts`` has, by place in the unpacked bytes, where in the file members begin.
    """

    def __init__(self, read: Callable[[int], bytes], step: int = 1 << 20):
        self.read, self.step = read, step
        self.plain: bool | None = None
        self.unzip = zlib.decompressobj(31)
        self.buffer, self.offset = bytearray(), 0
        self.at, self.done, self.starts = 0, 0, {0: 0}  # bytes read of the file, bytes unpacked

    def _more(self) -> bool:
        part = self.read(self.step)
        if not part:
            return False
        self.at += len(part)
        if self.plain is None:
            self.plain = part[:1] != b"\x1f"
        if self.plain:
            self.buffer += part
            self.done += len(part)
            return True
        while part:
            out = self.unzip.decompress(part)
            self.buffer += out
            self.done += len(out)
            part = self.unzip.unused_data
            if self.unzip.eof:  # the next member of the file
                self.starts[self.done] = self.at - len(part)
                self.unzip = zlib.decompressobj(31)
        return True

    def place(self) -> int | None:
        """Where in the file what comes next begins; None within a member."""
        if self.plain:
            return self.offset
        found = self.starts.get(self.offset)
        self.starts = {k: v for k, v in self.starts.items() if k >= self.offset}
        return found

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is dropped; None at the end of the file."""
        look = 0
        while (found := self.buffer.find(mark, look)) < 0:
            look = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        return self.take(found + len(mark))[: -len(mark)]

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        if len(self.buffer) < n:
            raise ValueError("a WARC record is cut short")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.offset += n
        return out


def parse(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes, int | None, int | None]]:
    """(header fields in lower case, block, offset, length) of each record of a file that ``read`` reads on in.

    Offset and length count the file's bytes, of the record's gzip member; they are None for records that share a member.
    """
    stream = _Unpacked(read)
    while True:
        head = stream.until(BREAK.encode())
        if head is None:
            return
        begin = stream.offset - len(head) - len(BREAK)
        where = begin if stream.plain else stream.starts.get(begin)
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record at {begin}: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        block = stream.take(int(fields["content-length"]))
        stream.take(len(BREAK))
        while not stream.plain and stream.offset == stream.done and stream.offset not in stream.starts and stream._more():
            pass  # until the member's end is seen
        end = stream.place()
        yield fields, block, *((where, end - where) if where is not None and end is not None else (None, None))


def _page(uri: str) -> int | None:
    found = re.search(r"-?\d+", uri)
    return int(found[0]) if found else None


def _entry(fields: dict[str, str], block: bytes, file: str, offset: int, length: int) -> tuple:
    kind = fields["warc-type"]
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode() if kind == "response" else fields["warc-payload-digest"].partition(":")[2]
    if fields["warc-payload-digest"] != f"sha1:{digest}":
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    size = len(block) if kind == "response" else int(fields["warc-refers-to-payload-length"])
    stamp = re.sub(r"\D", "", fields["warc-date"])
    return _page(fields["warc-record-id"]), url_key(fields["warc-target-uri"]), stamp, kind, refers, size, digest, file, offset, length


def _order(entry: tuple) -> tuple:
    """Rank of an index entry: URL key, timestamp, page, then where it stands."""
    return entry[1].encode(), entry[2], entry[0] is not None, entry[0] or 0, entry[7], entry[8] or 0


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if "long" in f else pa.string() for f in INDEX.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ENTRY]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(ENTRY))


def read_runs(spark, path: str) -> DataFrame:
    """The captures in the archives below ``path``: each file's index entries, in order of the index."""

    def run(batches):
        store, folder = _store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    rows = sorted((_entry(f, b, name, at, n) for f, b, at, n in parse(file.read)), key=_order)
                for i in range(0, len(rows), 10_000):
                    yield _table(rows[i : i + 10_000])

    files = spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest").select("file")
    return files.repartition(4 * spark.sparkContext.defaultParallelism, "file").mapInArrow(lean(run), INDEX)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path of log2(k) matches."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [self._next(i) for i in range(k)]
        self.losers = [-1] * k
        for i in range(k):
            self._replay(i, building=True)

    def _next(self, i: int):
        entry = next(self.runs[i], None)
        return None if entry is None else (_order(entry), i, entry)

    def _beats(self, i: int, j: int) -> bool:
        if self.heads[i] is None or self.heads[j] is None:
            return self.heads[i] is not None
        return self.heads[i][:2] < self.heads[j][:2]

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:  # the first to arrive waits for its match
                self.losers[node] = i
                return
            if other >= 0 and self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[best := self.losers[0]] is not None:
            yield self.heads[best][2]
            self.heads[best] = self._next(best)
            self._replay(best)


def _stored(store: fs.FileSystem, path: str) -> Iterator[tuple]:
    with store.open_input_stream(path, compression=None, buffer_size=1 << 16) as stored:
        while True:
            try:
                yield from pickle.load(stored)
            except EOFError:
                return


def merge_runs(entries: Iterator[tuple], shared: str, memory_rows: int = MEMORY_ROWS) -> Iterator[tuple]:
    """All entries in order of the index. They come as ascending stretches, the pieces of the runs, which are merged; pieces of
    ``memory_rows`` rows in all are merged to a file in a folder of the task's own in the ``shared`` one, and the files in the end."""
    store, folder = _store(f"{shared}/{uuid.uuid4().hex}")
    pieces: list[list[tuple]] = []
    files: list[str] = []
    held, last = 0, None

    def put_away() -> None:
        store.create_dir(folder, recursive=True)
        files.append(f"{folder}/{len(files)}")
        with store.open_output_stream(files[-1], compression=None, buffer_size=1 << 16) as out:
            some = []
            for entry in LoserTree([iter(p) for p in pieces]):
                some.append(entry)
                if len(some) == 1000:
                    pickle.dump(some, out)
                    some = []
            pickle.dump(some, out)

    for entry in entries:
        rank = _order(entry)
        if last is None or rank < last:
            pieces.append([])
        pieces[-1].append(entry)
        last, held = rank, held + 1
        if held >= memory_rows:
            put_away()
            pieces, held, last = [], 0, None
    yield from LoserTree([_stored(store, f) for f in files] + [iter(p) for p in pieces])
    if files:
        store.delete_dir(folder)


def merge_index(runs: DataFrame, n_rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs, ordered by URL key, timestamp and page over the whole result."""
    shared = scratch_path(runs.sparkSession, "runs")

    def run(batches):
        rows = (entry for batch in batches for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        some = []
        for entry in merge_runs(rows, shared):
            some.append(entry)
            if len(some) == 10_000:
                yield _table(some)
                some = []
        if some:
            yield _table(some)

    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, -(-n_rows // range_rows))
    return runs.repartitionByRange(ranges, "url_key", "ts", "page_id", "file", "offset").mapInArrow(lean(run), INDEX)


def capture_histories(pages: DataFrame, path: str, least: int = 0, date_col: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` to ``path``, read them back, and return their index in global order.

    An empty table gives an empty index. Rows that repeat a page are captures of their own; a null page_id gives way to any other
    and stays null. Columns other than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    write_archives(pages, path, least, date_col=date_col)
    n_rows = spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest").agg(F.sum("records")).first()[0] or 0
    return merge_index(materialise(read_runs(spark, path), "captures"), n_rows)


def op4_warc(spark, sf_dir):
    return capture_histories(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_DIGITS = " || ".join(
    f"substr('{BASE32}', ((('0x' || substr(hex, {5 * g + 1}, 5))::INT >> {15 - 5 * i}) & 31) + 1, 1)" for g in range(8) for i in range(4)
)
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p
"""
