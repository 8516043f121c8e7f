"""Web pages as WARC archives: written with one gzip member per record, read back in sequence.

Writing: pages meet the digest groups they belong to, then every task writes
archives of its own. Files that an attempt left behind when it was lost are never
read, as only the files of the attempts that Spark committed are in the manifest.

Reading: one task per archive goes through it from begin to end. A member is
decompressed piece by piece, its head is read line by line, its block is framed by
`Content-Length` and digested as it comes, so memory does not grow with records or
archives (unless payloads are asked for). A damaged record is reported, and reading
goes on at the next member that begins a record.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.attach import attach
from cohortloom.llm.blocks import bounded_batches
from cohortloom.session import materialise, scratch_path

# Fixed values of the format.
VERSION = b"WARC/1.1"
LINE_END = b"\r\n"
GZIP_MAGIC = b"\x1f\x8b\x08"
GZIP_WINDOW = 31
RESPONSE_TYPE = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_SCHEME = "urn:page:"

PIECE = 256 << 10
HEAD_LIMIT = 1 << 20


class Damaged(Exception):
    """What is wrong with a record."""


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path (local, hdfs, s3, gs) and the path in it."""
    scheme, colon, rest = path.partition(":")
    if scheme == "file":
        path = "file://" + "/" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        path = "s3" + colon + rest
    return pafs.FileSystem.from_uri(path)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


# --- writing ---


def member(head: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member; `Content-Length` and the block's digest are added."""
    lines = [VERSION]
    own = [("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())), ("Content-Length", len(block))]
    lines += [f"{name}: {value}".encode() for name, value in [*head, *own]]
    engine = zlib.compressobj(6, zlib.DEFLATED, GZIP_WINDOW)
    whole = LINE_END.join([*lines, b"", block, b"", b""])
    return engine.compress(whole) + engine.flush()


def page_record(key: str, url: str, payload: bytes, digest: bytes, refers: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit that only has the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    head = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<{ID_SCHEME}{quote(key, safe='')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", "sha1:" + base32(digest)),
        ("Content-Type", RESPONSE_TYPE),
    ]
    if refers is None:
        return member(head, http.encode() + payload)
    head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID_SCHEME}{quote(refers, safe='')}>")]
    return member(head, http.encode())


def info_record(name: str, date: str) -> bytes:
    head = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
    ]
    return member(head, b"format: WARC File Format 1.1\r\n")


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    max_bytes: int = 256 << 20,
    date: str | None = None,
) -> DataFrame:
    """Write one record per page below `folder`; returns (path, records, bytes) of the archives.

    The payload is the html in UTF-8; NULL is empty. Of pages with equal payloads
    of at least `least_bytes` bytes, those with the largest key are responses and
    the others revisits that refer to it; smaller payloads are always responses.
    Repeated rows are records of their own. NULL keys are below all others and
    have an empty name in their record id; NULL addresses are empty. An archive
    is closed once it has `max_bytes`. `folder` (a new one in the scratch area
    unless given) must be one that all executors share. An empty table gives no
    archives.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    small = F.octet_length("payload") < least_bytes
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.filter(~small).groupBy("digest").agg(F.max("key").alias("owner"), F.count("*").alias("n"))
    groups = materialise(groups.filter("n > 1"), "digest-groups")
    met = attach(rows, groups, "digest", "n", F.col("key"))
    again = ~small & F.col("owner").isNotNull() & ~F.col("key").eqNullSafe(F.col("owner"))
    met = met.select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"),
        F.coalesce("url", F.lit("")).alias("url"),
        "payload",
        F.unhex("digest").alias("digest"),
        F.when(again, F.col("owner").cast("string")).alias("refers"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, records, size = None, None, 0, 0

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(5)]
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, records = f"{folder}/{name}", 0
                    store, base = open_store(folder)
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                    first = info_record(name, date)
                    sink.write(first)
                    size = len(first)
                packed = page_record(*row, date)
                sink.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= max_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    return materialise(met.mapInArrow(write, "path string, records long, bytes long"), "archives")


# --- reading ---


class Source:
    """A seekable stream as pieces that can be given back."""

    def __init__(self, stream) -> None:
        self.stream = stream
        self.kept = b""
        self.at = 0

    def take(self) -> bytes:
        data = self.kept or self.stream.read(PIECE)
        self.kept = b""
        self.at += len(data)
        return data

    def give_back(self, data: bytes) -> None:
        self.kept = data + self.kept
        self.at -= len(data)

    def go(self, at: int) -> None:
        self.stream.seek(at)
        self.kept, self.at = b"", at


class Member:
    """The content of the gzip member that begins where the source stands."""

    def __init__(self, source: Source) -> None:
        self.source = source
        self.engine = zlib.decompressobj(GZIP_WINDOW)
        self.ready = b""

    def _more(self) -> bool:
        """Decompress up to one more piece; False at the member's end."""
        while not self.engine.eof:
            data = self.engine.unconsumed_tail or self.source.take()
            try:
                out = self.engine.decompress(data, PIECE)
            except zlib.error as error:
                raise Damaged("not a gzip member") from error
            if self.engine.eof and self.engine.unused_data:
                self.source.give_back(self.engine.unused_data)
            if out:
                self.ready += out
                return True
            if not data and not self.engine.eof:
                raise Damaged("truncated member")
        return False

    def line(self) -> bytes:
        """A line without its end."""
        start = 0
        while (end := self.ready.find(LINE_END, start)) < 0:
            start = max(len(self.ready) - 1, 0)
            if start > HEAD_LIMIT or not self._more():
                raise Damaged("unfinished head")
        found, self.ready = self.ready[:end], self.ready[end + 2 :]
        return found

    def read(self, n: int) -> bytes:
        """At most n bytes; none at the member's end."""
        if not self.ready and not self._more():
            return b""
        found, self.ready = self.ready[:n], self.ready[n:]
        return found


def fields(line: Callable[[], bytes]) -> dict[str, str]:
    """Named fields up to an empty line; names in lower case, folded lines joined, the first of a name counts."""
    found: dict[str, str] = {}
    last = None
    total = 0
    while text := line():
        total += len(text)
        if total > HEAD_LIMIT:
            raise Damaged("unfinished head")
        if text[:1] in b" \t" and last is not None:
            found[last] += " " + text.strip().decode("utf-8", "replace")
            continue
        name, colon, value = text.partition(b":")
        if not colon:
            raise Damaged("field without a colon")
        last = name.strip().decode("utf-8", "replace").lower()
        found.setdefault(last, value.strip().decode("utf-8", "replace"))
    return found


def _checked(stated: str | None, got: bytes | None) -> bool:
    """Whether a stated digest agrees; digests of other kinds are not checked."""
    kind, _, value = (stated or "").partition(":")
    return got is None or kind.lower() != "sha1" or value.upper() == base32(got)


def read_record(one: Member, with_payload: bool) -> dict:
    """Everything of one record; its `problem` is None when framing and digests agree."""
    found: dict = dict.fromkeys(RECORD_FIELDS)
    try:
        if not one.line().startswith(b"WARC/"):
            raise Damaged("no record begins here")
        head = fields(one.line)
        found["record_type"] = head.get("warc-type")
        found["record_id"] = head.get("warc-record-id")
        found["target_uri"] = head.get("warc-target-uri")
        found["date"] = head.get("warc-date")
        found["refers_to"] = head.get("warc-refers-to")
        stated = head.get("warc-payload-digest")
        if stated is not None:
            found["payload_digest"] = stated.partition(":")[2] or stated
        length = head.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise Damaged("no content length")
        _read_block(one, int(length), head, found, with_payload)
    except Damaged as damage:
        found["problem"] = str(damage)
    return found


def _read_block(one: Member, length: int, head: dict[str, str], found: dict, with_payload: bool) -> None:
    """The block by its stated length: digests, the size of the payload, and what follows it."""
    is_http = head.get("content-type", "").startswith("application/http")
    stated = head.get("warc-payload-digest")
    whole, inner = hashlib.sha1(), hashlib.sha1()
    pending, http, kept, size = b"", None, [], 0
    left = length
    while left:
        data = one.read(left)
        if not data:
            raise Damaged("block shorter than its content length")
        left -= len(data)
        whole.update(data)
        if is_http and http is None:
            # The HTTP head ends with an empty line; the payload follows it.
            pending += data
            end = pending.find(LINE_END * 2)
            if end < 0:
                if len(pending) > HEAD_LIMIT:
                    raise Damaged("unfinished HTTP head")
                continue
            lines = iter([*pending[:end].split(LINE_END)[1:], b""])
            http = fields(lambda: next(lines))
            data, pending = pending[end + 4 :], b""
        inner.update(data)
        size += len(data)
        if with_payload:
            kept.append(data)
    if is_http and http is None:
        raise Damaged("unfinished HTTP head")
    found["content_length"] = length
    revisit = found["record_type"] == "revisit"
    claimed = (http or {}).get("content-length", "")
    found["payload_bytes"] = size
    if revisit:
        found["payload_bytes"] = int(claimed) if claimed.isascii() and claimed.isdigit() else None
    elif with_payload:
        found["payload"] = b"".join(kept)
    if stated is None and not revisit:
        found["payload_digest"] = base32(inner.digest())
    tail = b""
    while len(tail) <= 4 and (data := one.read(PIECE)):
        tail += data[: 5 - len(tail)]
    if tail != LINE_END * 2:
        raise Damaged("no record end after the block")
    if not _checked(head.get("warc-block-digest"), whole.digest()):
        raise Damaged("block digest differs")
    if not _checked(stated, None if revisit else inner.digest()):
        raise Damaged("payload digest differs")


def _next_member(source: Source, start: int) -> bool:
    """Go to the next place at or after `start` where a member begins a record."""
    source.go(start)
    rest = b""
    while data := source.take():
        window = rest + data
        first = source.at - len(window)
        place = window.find(GZIP_MAGIC)
        while place >= 0:
            source.go(first + place)
            try:
                if Member(source).read(5) == b"WARC/":
                    source.go(first + place)
                    return True
            except Damaged:
                pass
            place = window.find(GZIP_MAGIC, place + 1)
        source.go(first + len(window))
        rest = window[-2:]
    return False


def records(stream, with_payload: bool = False) -> Iterator[dict]:
    """Every record of an archive in order, with its offset; damaged ones with their problem."""
    source = Source(stream)
    while True:
        data = source.take()
        if not data:
            return
        source.give_back(data)
        start = source.at
        one = Member(source)
        found = read_record(one, with_payload)
        found["offset"] = start
        try:
            while one.read(PIECE):
                pass
        except Damaged as damage:
            found["problem"] = found["problem"] or str(damage)
        yield found
        if not one.engine.eof and not _next_member(source, start + 1):
            return


RECORD_FIELDS = (
    "offset record_type record_id target_uri date refers_to content_length payload_bytes payload_digest problem payload"
).split()


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives named in the column `path`, one task per archive.

    path, offset, record_type, record_id, target_uri, date, refers_to,
    content_length, payload_bytes, payload_digest (bare base32), problem, and
    payload if asked for. `problem` is NULL for a sound record and else names the
    first fault: damaged or truncated member, unfinished head, missing length, a
    block that does not fit its length, differing digests. Such a record is kept
    with the fields read before; reading goes on with the next. For a revisit
    the payload's size is the one its HTTP head states. Every path is read as
    often as it is listed; NULL paths are left out.
    """
    names = RECORD_FIELDS if with_payload else RECORD_FIELDS[:-1]
    longs = ("offset", "content_length", "payload_bytes")
    kinds = {n: pa.int64() if n in longs else pa.binary() if n == "payload" else pa.string() for n in names}
    plain = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    schema = "path string, " + ", ".join(f"{n} {plain[k]}" for n, k in kinds.items())
    arrow = pa.schema([("path", pa.string()), *kinds.items()])
    paths = archives.select("path").filter("path IS NOT NULL")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inside = open_store(path)
                rows, size = [], 0
                with store.open_input_file(inside) as stream:
                    for found in records(stream, with_payload):
                        rows.append({"path": path, **{n: found[n] for n in names}})
                        size += 200 + len(found["payload"] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return paths.repartition(max(paths.count(), 1)).mapInArrow(read, schema)


def key_of(record_id: Column) -> Column:
    """The page's key, as text, from a record id of `write_archives`; NULL for other ids and empty names."""
    name = F.regexp_extract(record_id, f"^<{ID_SCHEME}(.+)>$", 1)
    return F.when(name != "", F.url_decode(name))
