"""WARC archives: a deduplicating writer, and a PySpark Python data source that reads them.

The source plans one partition a file, takes over predicates on the record type and on other
headers, parses a record's header block first and then seeks past every payload that the schema
does not ask for or that a predicate rules out; in compressed archives (one gzip member a record)
such payloads are inflated no further than needed to find the next record, and never decoded.
"""

from __future__ import annotations

import base64
import contextlib
import quopri
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from .common import Scratch, hot_join, lean, prepare, session_folder, small_enough

SCHEMA = "record_id string, type string, uri string, date string, digest string, refers_to string, http_length long, payload binary"
_HEADER = {"record_id": "warc-record-id", "type": "warc-type", "uri": "warc-target-uri", "date": "warc-date", "digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_LIST = "_files"  # table of the files that a write has committed, in the archives' folder
_WORD = re.compile(r"=\?utf-8\?([bq])\?([^? ]*)\?=", re.IGNORECASE | re.ASCII)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it: any store that pyarrow opens by URI, or a local path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, inside = (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)
    return store, inside.rstrip("/")


def _field(value: str) -> str:
    """A header value: the text as it is, or an encoded word (RFC 2047) where it could not be read back so."""
    plain = value == value.strip(" \t") and not re.search(r"[\x00-\x1f\x7f]", value) and not _WORD.fullmatch(value)
    return value if plain else f"=?utf-8?B?{base64.b64encode(value.encode()).decode()}?="


def _text(value: str) -> str:
    word = _WORD.fullmatch(value)
    if word is None:
        return value
    raw = base64.b64decode(word[2]) if word[1] in "bB" else quopri.decodestring(word[2].encode(), header=True)
    return raw.decode("utf-8", "replace")


# --- writer ---------------------------------------------------------------------------------------


def _record(page, url, payload: bytes, digest: str, length: int, head, date: str) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if head is None else 'revisit'}"]
    if page is not None:
        lines.append(f"WARC-Record-ID: <urn:x-page:{page}>")
    lines.append(f"WARC-Date: {date}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if head is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{head}>", f"WARC-Profile: {_PROFILE}"]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"".join([("\r\n".join(lines)).encode(), _END, http, payload, _END])


def _writer(path: str, date: str, max_file_bytes: int, compress: bool):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _filesystem(path)
        store.create_dir(root, recursive=True)
        # Each attempt has names of its own: what a failed or second one leaves is in no committed list.
        part, attempt = task.partitionId(), uuid.uuid4().hex
        state = {"out": None, "n": 0, "bytes": 0, "file": 0, "name": ""}
        done = []

        def finish():
            state["out"].close()
            done.append((state["name"], state["n"], state["bytes"]))
            state.update(out=None, n=0, bytes=0, file=state["file"] + 1)

        for batch in batches:
            pages, urls, heads, digests, sizes = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            html = batch.column(2)
            for i in range(batch.num_rows):
                payload = b"" if heads[i] is not None else (html[i].as_buffer() or b"")
                raw = _record(pages[i], urls[i], payload, digests[i], sizes[i], heads[i], date)
                if compress:
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = gz.compress(raw) + gz.flush()
                if state["out"] is None:
                    state["name"] = f"part-{part:06d}-{state['file']:04d}-{attempt}.warc{'.gz' if compress else ''}"
                    state["out"] = store.open_output_stream(f"{root}/{state['name']}", compression=None)
                state["out"].write(raw)
                state["n"] += 1
                state["bytes"] += len(raw)
                if state["bytes"] >= max_file_bytes:
                    finish()
        if state["out"] is not None:
            finish()
        for name, n, size in done:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, path: str, least_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z", max_file_bytes: int = 1 << 30, compress: bool = False, broadcast_rows: int = 200_000) -> DataFrame:
    """Write a record for every row (page_id, url, html) under `path`; returns (file, records, bytes).

    Of records with equal payloads of at least `least_revisit` bytes the one with the largest
    page_id is a response, the others are revisits that refer to it.  A null html is an empty
    payload; rows with a null page_id are always responses without a record id, as are all rows of
    the largest page_id if that repeats; a null url leaves out the header; no rows write no file.
    The list of files is written last, as a table in the folder, by Spark's commit: a reader takes the
    files it names and no others, so a repeated or lost task never adds a record twice.
    Payloads are never shuffled as long as the table of revisits (two ids and a digest a row) has
    at most `broadcast_rows` rows; beyond that it is joined by a shuffle.
    """
    prepare(pages.sparkSession)
    body = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    scratch = Scratch(pages.sparkSession, "warc-digests")
    narrow = scratch.save(rows.where((F.col("size") >= least_revisit) & F.col("page_id").isNotNull()).select("page_id", F.unhex("digest").alias("sha")), "digests")
    heads = scratch.save(narrow.groupBy("sha").agg(F.max("page_id").alias("head"), F.count("*").alias("docs")).where("docs > 1"), "heads")
    revisits = hot_join(narrow, heads, ["sha"]).where("page_id < head").select("page_id", F.lower(F.hex("sha")).alias("digest"), "head").distinct()
    if small_enough(revisits, broadcast_rows):
        revisits = F.broadcast(revisits)
    out = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "head", "digest", "size")
    done = out.mapInArrow(lean(_writer(path, date, max_file_bytes, compress)), "file string, records long, bytes long")
    store_list = f"{path}/{_LIST}"
    done.write.parquet(store_list)
    return pages.sparkSession.read.schema(done.schema).parquet(store_list)


# --- reader ---------------------------------------------------------------------------------------


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _passes(kind: str, wanted, value) -> bool:
    if kind == "in":
        return value in wanted
    if kind == "prefix":
        return value is not None and value.startswith(wanted)
    return value is not None


def _value(name: str, headers: dict) -> str | None:
    value = headers.get(_HEADER[name])
    if value is None:
        return None
    return value.strip("<>") if name in ("record_id", "refers_to") else _text(value)


def _headers(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; of a repeated one the last; a line that starts with a blank goes on the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip(" \t")
            continue
        name, _, value = line.partition(":")
        name = name.strip(" \t").lower()
        out[name] = value.strip(" \t")
    return out


@contextlib.contextmanager
def _named(path: str):
    try:
        yield
    except (ValueError, zlib.error) as wrong:
        raise ValueError(f"{path}: {wrong}") from wrong


class _Plain:
    """Forward reader of an uncompressed archive: reads headers, seeks past blocks."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.at, self.buffer, self.base = stream, size, 0, b"", 0

    def _fill(self, start: int, n: int) -> bytes:
        if start < self.base or start + n > self.base + len(self.buffer):
            self.stream.seek(start)
            self.buffer, self.base = self.stream.read(max(n, 1 << 16)), start
        return self.buffer[start - self.base : start - self.base + n]

    def head(self) -> bytes | None:
        if self.at >= self.size:
            return None
        n = 4096
        while True:
            raw = self._fill(self.at, n)
            end = raw.find(_END)
            if end >= 0:
                self.at += end + 4
                return raw[:end]
            if self.at + n >= self.size:
                raise ValueError(f"no end of a header at byte {self.at}")
            n *= 2

    def block(self, n: int) -> bytes:
        self._within(n)
        raw = self._fill(self.at, n)
        self.at += n + 4
        return raw

    def skip(self, n: int, peek: int = 0) -> bytes:
        self._within(n)
        raw = self._fill(self.at, min(n, peek)) if peek else b""
        self.at += n + 4
        return raw

    def _within(self, n: int) -> None:
        if self.at + n > self.size:
            raise ValueError(f"truncated record: its block of {n} bytes begins at byte {self.at} of {self.size}")


class _Members:
    """Reader of an archive with one gzip member a record."""

    def __init__(self, stream, size: int):
        self.stream, self.rest, self.inflate, self.text = stream, b"", None, b""

    def _more(self) -> bytes | None:
        """The next inflated bytes of the member, None at the end of the file."""
        raw = self.rest or self.stream.read(1 << 16)
        self.rest = b""
        if not raw:
            return None
        text = self.inflate.decompress(raw, 1 << 16)
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return text

    def head(self) -> bytes | None:
        self.rest = self.rest or self.stream.read(1 << 16)
        if not self.rest:
            return None
        self.inflate, self.text = zlib.decompressobj(31), b""
        while (end := self.text.find(_END)) < 0:
            more = None if self.inflate.eof else self._more()
            if more is None:
                raise ValueError("no end of a header")
            self.text += more
        head, self.text = self.text[:end], self.text[end + 4 :]
        return head

    def block(self, n: int) -> bytes:
        return self._rest(n, n)

    def skip(self, n: int, peek: int = 0) -> bytes:
        return self._rest(n, min(n, peek))

    def _rest(self, n: int, keep: int) -> bytes:
        """The first `keep` bytes of a block of n; inflates to the end of the member."""
        parts, seen = [self.text[:keep]], len(self.text)
        self.text = b""
        while not self.inflate.eof:
            more = self._more()
            if more is None:
                raise ValueError("truncated member")
            if seen < keep:
                parts.append(more[: keep - seen])
            seen += len(more)
        if seen < n:
            raise ValueError(f"truncated record: {seen} of {n} bytes of its block")
        return b"".join(parts)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.schema = pa.schema([(n, {"http_length": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in self.names])
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the warc source needs a path")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in _HEADER:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(v for v in f.value if v is not None)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self):
        store, root = _filesystem(self.path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            return []
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        listed = f"{root}/{_LIST}"
        if store.get_file_info(listed).type == pafs.FileType.Directory:
            if store.get_file_info(f"{listed}/_SUCCESS").type == pafs.FileType.NotFound:
                raise ValueError(f"{self.path}: the write of these archives has not ended")
            named = {f"{root}/{x}" for x in pq.read_table(listed, filesystem=store, columns=["file"]).column("file").to_pylist()}
            files = [f for f in files if f.path in named]
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition):
        if partition is None:
            return
        store, _ = _filesystem(self.path)
        with store.open_input_file(partition.path) as stream, _named(partition.path):
            archive = (_Members if partition.path.endswith(".gz") else _Plain)(stream, stream.size())
            rows: list[tuple] = []
            held = 0
            while (head := archive.head()) is not None:
                version, *lines = head.decode("utf-8", "replace").split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError(f"not a record: {version[:40]!r}")
                headers = _headers(lines)
                if not headers.get("content-length", "").isdigit():
                    raise ValueError("a record without a length")
                n = int(headers["content-length"])
                if not all(_passes(kind, wanted, _value(name, headers)) for name, kind, wanted in self.tests):
                    archive.skip(n)
                    continue
                is_http = headers.get("content-type", "").startswith("application/http")
                payload, http_length = None, None
                if "payload" in self.names and headers.get("warc-type") != "revisit":
                    block = archive.block(n)
                    cut = block.find(_END) + 4 if is_http else 0
                    payload, http = block[cut:], block[:cut]
                else:
                    http = archive.skip(n, 1 << 14 if is_http and "http_length" in self.names else 0)
                for line in http.split(b"\r\n"):
                    if line.lower().startswith(b"content-length:"):
                        http_length = int(line[15:])
                        break
                rows.append(tuple(payload if c == "payload" else http_length if c == "http_length" else _value(c, headers) for c in self.names))
                held += len(payload or b"") + 300
                if held > 8_000_000:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema)


class WarcDataSource(DataSource):
    """spark.read.format("warc").schema(any of SCHEMA's columns).load(path); without payload in the schema no payload is read."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The records of the archives at `path` (a file or a folder), with any of SCHEMA's columns.

    Text columns are the headers' values as they stand, but for the brackets around record ids and for
    encoded words; a header that is not there is null; `payload` is null for revisits, `http_length` is
    null without an HTTP header of that name.  Records that repeat are rows that repeat; other headers
    are ignored; a path without archives gives no rows.  An archive that ends inside a record, holds
    something else than records, or a record without a length, fails with its path.  A folder that
    write_warc wrote is read by its list of files.  One partition is one file; compressed archives must
    hold one member a record.  Switches on filter pushdown to Python sources in the session.
    """
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").schema(columns).load(path)


def _page(column: str):
    return F.regexp_extract(column, r"^urn:x-page:(-?\d+)$", 1).cast("long")


def warc_round_trip(pages: DataFrame, least_revisit: int = 1000) -> DataFrame:
    """Write `pages` to archives and read them back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, whose digests must equal the headers'; revisits by
    their headers alone.
    """
    spark = pages.sparkSession
    path = f"{session_folder(spark, 'warc')}/pages"
    write_warc(pages, path, least_revisit)
    heads = "record_id string, type string, uri string, digest string, refers_to string, http_length long"
    whole = read_warc(spark, path, heads + ", payload binary").where("type = 'response'")
    sha = F.sha1("payload")
    said = _hex_of_base32(F.substring_index("digest", ":", -1))
    whole = whole.select(
        F.when(F.col("record_id").isNotNull(), _page("record_id")).alias("page_id"), F.col("uri").alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(sha == said, sha).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.coalesce("record_id", F.lit("?"))))).alias("payload_digest"),
        F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    other = read_warc(spark, path, heads).where("type = 'revisit'").select(
        _page("record_id").alias("page_id"), F.col("uri").alias("url"), F.col("http_length").alias("payload_bytes"), said.alias("payload_digest"), F.col("type").alias("record_type"), _page("refers_to").alias("refers_to")
    )
    return whole.union(other)


def _hex_of_base32(column):
    """Lower-case hex of an RFC 4648 base32 text of 32 characters, with built-in functions alone."""
    bits = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    # Base 32 digits to base 16 in four groups of 8 digits (40 bits, 10 hex digits each).
    groups = [F.lpad(F.lower(F.conv(F.substring(bits, 1 + 8 * k, 8), 32, 16)), 10, "0") for k in range(4)]
    return F.concat(*groups)
