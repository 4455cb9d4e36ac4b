"""WARC archives: a writer through Spark's own committer and a splittable reader.

Writer: every record is a gzip member of its own; Spark's text sink writes the members' raw bytes, so the file
system, retries and commit are Spark's. The sink ends each row with one separator byte; a member ends with the
high byte of its length, zero below 16 MiB, so that byte is left out and the separator, a zero byte, stands
for it (a larger record is followed by an empty member, which ends in a zero byte).

Reader: a task has a byte range of a file. It looks for the gzip magic, decodes the header behind each candidate
to see whether a WARC record starts there, and owns the members that start inside its range, reading past the
end for the last of them. A member may hold one record or many (a file compressed as a whole is one member, read
by one task). Versions 1.0 and 1.1 are read, header names in any case. Records are streamed: nothing larger than
one record is held. A record whose payload is cut off or damaged is passed over, and the search goes on behind
its magic.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.arrow import small_batches
from attesta.store import new_path, table, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: A record's first line, whatever minor version it is of.
_FIRST_LINE = re.compile(rb"WARC/1\.[0-9]{1,3}[ \t]*\r?\n")
_CHUNK, _BLOCK = 1 << 16, 1 << 20
#: Bytes that a record's headers may take.
_HEADERS = 1 << 20
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
#: The alphabet of RFC 4648 base32 (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The date of records that come with none: archives of the same rows are the same.
DATE = "1970-01-01T00:00:00Z"


def member(headers: dict[str, str], payload: bytes, version: bytes = VERSION) -> bytes:
    """One record as one gzip member."""
    head = version + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + payload + b"\r\n\r\n") + packer.flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(x: str | None) -> str:
    """A header value: nothing that could end its line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in x or "")


def write_warc(records: DataFrame, path: str, date: str = DATE) -> None:
    """records (page_id long, url string, payload binary, digest string, record_type, refers_to long) -> files in path.

    A null payload is empty. Revisit records carry no payload but its digest, its length and the id referred to.
    All records bear the given date.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, url, payload, sha, kind, refers in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")], strict=True):
                payload = payload or b""
                headers = {"WARC-Type": kind, "WARC-Date": date, "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Target-URI": _one_line(url), "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Payload-Length": str(len(payload))}
                if kind == "revisit":
                    headers |= {"WARC-Refers-To": f"<urn:page:{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    payload = b""
                packed = member(headers | {"Content-Length": str(len(payload))}, payload)
                if packed[-1]:
                    packed += _EMPTY
                yield pa.RecordBatch.from_arrays([pa.array([packed[:-1]], pa.binary())], ["value"])

    rows = records.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "value binary")
    with small_batches(records.sparkSession):
        rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Window:
    """A file read block by block; the last block is kept, so records that follow each other share reads."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.base, self.block = file, file.size(), 0, b""

    def get(self, at: int, least: int = 1) -> bytes:
        """Bytes from `at` on: at least so many unless the file ends before."""
        if not self.base <= at <= self.base + len(self.block) - least and at < self.size:
            self.file.seek(at)
            self.base, self.block = at, self.file.read(_BLOCK)
        return self.block[at - self.base : at - self.base + _CHUNK]


class _Inflated:
    """The bytes of one gzip member of a file, decompressed as they are asked for."""

    def __init__(self, file: _Window, at: int):
        self.file, self.at, self.unpack, self.data, self.raw, self.broken = file, at, zlib.decompressobj(31), bytearray(), b"", False

    def more(self) -> bool:
        """Decompress a piece more; False at the member's end, the file's end or damage (then `broken`)."""
        while not self.unpack.eof and not self.broken:
            if not self.raw:
                self.raw = self.file.get(self.at) if self.at < self.file.size else b""
                self.at += len(self.raw)
                if not self.raw:
                    self.broken = True
                    return False
            try:
                out = self.unpack.decompress(self.raw, _CHUNK)
            except zlib.error:
                self.broken = True
                return False
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                self.data += out
                return True
        return False

    def upto(self, n: int) -> bool:
        """Whether n bytes are there, after decompressing as much as that takes."""
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    @property
    def end(self) -> int:
        """Where in the file the bytes not yet decompressed begin."""
        return self.at - len(self.raw)


def _headers(view: _Inflated) -> dict[str, str] | None:
    """The headers of the record at the front of the view, names in lower case; None if no record starts there."""
    while not (first := _FIRST_LINE.match(view.data)):
        if len(view.data) >= 32 or not view.more():
            return None
    searched = 0
    while not (blank := re.compile(rb"\r?\n\r?\n").search(view.data, max(0, searched - 4))):
        searched = len(view.data)
        if searched > _HEADERS or not view.more():
            return None
    lines = view.take(blank.end())[first.end() : blank.start()].decode("utf-8", "replace").splitlines()
    headers, name = {}, ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # goes on
            headers[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            headers[name] = value.strip()
    return headers


def _member_records(view: _Inflated) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a member; one of a length that is no number is passed over with the rest of the member."""
    while True:
        while view.data[:1] in (b"\r", b"\n"):
            del view.data[:1]
        if not view.data and not view.more():
            return
        if view.data[:1] in (b"\r", b"\n"):
            continue
        if (headers := _headers(view)) is None or not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
            return
        n = int(headers["content-length"])
        if not view.upto(n):
            return
        yield headers, view.take(n)


def records_in(fs: pa.fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content of each record whose gzip member starts in [start, end)."""
    with fs.open_input_file(path) as opened:
        file, at = _Window(opened), start
        while at < min(end, file.size):
            here = file.get(at, len(MAGIC))
            if (found := here.find(MAGIC)) < 0:
                at += max(1, len(here) - len(MAGIC) + 1)
                continue
            at += found
            if at >= end:
                return
            view, some = _Inflated(file, at), False
            for record in _member_records(view):
                some = True
                yield record
            if some and not view.broken:
                while view.more():  # what follows the last record in its member
                    view.data.clear()
            at = view.end if some and not view.broken else at + 1


def _page(uri: str | None) -> int | None:
    """The number of an id of ours; ids of other writers have none."""
    own = re.fullmatch("<urn:page:(-?[0-9]{1,19})>", uri or "")
    return int(own[1]) if own else None


def _row(headers: dict[str, str], body: bytes) -> tuple:
    """A record as read_warc has it."""
    get, kind = headers.get, headers.get("warc-type", "").lower()
    if get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        body = body.partition(b"\r\n\r\n")[2]  # the payload is what follows the HTTP headers
    length, sha = get("warc-payload-length", ""), get("warc-payload-digest", "")
    if kind == "revisit":
        n, sha = int(length) if re.fullmatch("[0-9]{1,18}", length) else None, sha[5:] if sha.lower().startswith("sha1:") else None
    else:
        n, sha = len(body), digest(body)
    return _page(get("warc-record-id")), get("warc-target-uri"), kind, _page(get("warc-refers-to")), body, n, sha, get("warc-record-id"), get("warc-date")


def read_warc(spark: SparkSession, path: str, split: int = 8 << 20, most_tasks: int = 100_000) -> DataFrame:
    """The records of all archives below path: page_id, url, record_type, refers_to, payload, payload_bytes,
    payload_digest, record_id, date.

    payload is what the record holds, without HTTP headers (empty for revisits of ours); bytes and digest are those
    of the full payload: counted and hashed anew from what was read, for revisits from the header, null where it
    has none. page_id and refers_to are null where ids are not numbers of ours; a missing header is null too.
    Folders without archives and empty files give no rows; repeated records come as often as they are there.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    tasks = min(most_tasks, files.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1)
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"), "length").withColumn("end", F.least(F.col("start") + split, "length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "record_id", "date"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for at in batch.to_pylist():
                fs, where = pa.fs.FileSystem.from_uri(at["path"])
                rows, held = [], 0
                for headers, body in records_in(fs, where, at["start"], at["end"]):
                    rows.append(_row(headers, body))
                    held += len(body)
                    if held > 1 << 22 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return ranges.repartition(tasks, "path", "start").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, record_id string, date string")


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1, eight groups of five hex digits to four letters."""
    letters, hexed = F.lit(BASE32), F.sha1(payload)
    letter = lambda v, shift: F.substring(letters, F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.array_join(F.transform(groups, lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)])), "")


def as_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html, ...) -> what write_warc takes.

    Of records with equal payloads of least_bytes or more, that with the largest page_id is the response, the
    others revisit it; smaller ones are all responses. Where rows repeat the largest id, all of these are
    responses. Payloads are equal where length and SHA-1 are. Null html is an empty payload; a null page_id
    revisits any other and is a response among nulls only.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload"))
    narrow = written(rows.where(F.col("n") >= least_bytes).select("page_id", "digest", "n"), "warc-digests")
    first = narrow.groupBy(F.col("digest").alias("d"), F.col("n").alias("m")).agg(F.max("page_id").alias("last"), F.count("*").alias("rows")).where("rows > 1 and last is not null").drop("rows")
    again = narrow.join(first, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m"))).where(~F.col("page_id").eqNullSafe(F.col("last")))
    # payloads are exchanged only where the revisits, whose size Spark knows from the written table, are many
    again = written(again.select(F.col("page_id").alias("p"), "d", "m", "last").distinct(), "warc-revisits")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(F.col("last").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("last").alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; awkward rows as in as_records."""
    path = new_path(spark, "warc")
    write_warc(as_records(table(spark, sf_dir, "pages")), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) h from pages),
m as (select *, max(page_id) over (partition by h, n) last from p)
select page_id, n::bigint payload_bytes,
  (select string_agg(substr('{BASE32}', ((v >> s) & 31)::int + 1, 1), '' order by i, s desc) from (select i, ('0x' || substr(h, i * 5 + 1, 5))::bigint v from (select unnest(range(8)) i)) g, (select unnest([15, 10, 5, 0]) s) t) payload_digest,
  case when page_id < last then 'revisit' else 'response' end record_type,
  case when page_id < last then last end refers_to
from m
"""
