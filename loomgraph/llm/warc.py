"""WARC archives with revisits, and a reader that salvages what damage has left (operator 6).

Writing: a record for each page, each its own gzip member (or plain).  Payloads are told apart by
SHA-1 and length; of equal ones that with the largest page_id is the response and the others are
revisits that refer to it and keep the HTTP header only, whose Content-Length is the payload's.

Reading: each record must inflate, begin with a version line, hold as many bytes as it says and
match its digests.  Where one fails, the reader searches for the next gzip member that begins with
a version line (in plain archives, the next version line), logs the bytes between as a gap with
the reason, and goes on from there.

Defined results: a null or empty html is an empty payload; rows that repeat the largest page_id of
their payload are responses all; a null page_id is a response only if no page with that payload
has an id; a null url has no target header; line ends in a url are percent-encoded; other columns
do not matter; an empty table makes no archive.
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

from loomgraph.llm._shared import new_folder, ready, store, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
READ = 1 << 20
#: Bytes that a record may have before it is known to be whole.
HOLD = 16 << 20
#: Bytes from which on an archive is closed and another begun.
ROLL = 1 << 30
#: Payloads that occur twice are sent to all tasks up to so many rows, some 10 MB.
SENT_ROWS = 200_000
OUT = "kind string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string, begin long, end long, reason string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None, sha1: str | None = None, size: int | None = None) -> bytes:
    """A WARC record; ``response``: the page that a revisit refers to, whose payload may be left out if its digest and ``size`` are given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http + payload if response is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if response is not None:
        head += [f"WARC-Refers-To: <{ID}{response}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha1 or digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Damage(Exception):
    pass


def parse(data: bytes) -> dict:
    """A whole record's fields; Damage if it does not hold together."""
    if not data.startswith(b"WARC/1."):
        raise Damage("no version line")
    at = data.find(b"\r\n\r\n")
    if at < 0:
        raise Damage("header without end")
    fields = {}
    for line in data[:at].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or len(data) != at + 8 + int(size) or not data.endswith(b"\r\n\r\n"):
        raise Damage("length differs")
    block = data[at + 4 : -4]
    if fields.get(b"warc-block-digest", b"sha1:" + digest(block).encode()) != b"sha1:" + digest(block).encode():
        raise Damage("block digest differs")
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":")[1].strip().isdigit()), None)
    told = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    if kind == "response" and (told != digest(payload) or length != len(payload)):
        raise Damage("payload digest differs")

    def number(name):
        text = fields.get(name, b"").decode("ascii", "replace").strip("<>").removeprefix(ID)
        return int(text) if text.lstrip("-").isdigit() else None

    return {"page_id": number(b"warc-record-id"), "payload_bytes": length, "payload_digest": told, "record_type": kind, "refers_to": number(b"warc-refers-to"), "url": fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None, "payload": payload if kind == "response" else None}


class Tape:
    """A file of which a window is held, from ``base`` on; what was dropped is read again if it is asked for."""

    def __init__(self, stream):
        self.stream, self.held, self.base, self.over = stream, bytearray(), 0, False

    def more(self) -> bool:
        data = b"" if self.over else self.stream.read(READ)
        self.over = not data
        self.held += data
        return not self.over

    def back(self, at: int) -> None:
        if at < self.base:
            self.stream.seek(at)
            self.held, self.base, self.over = bytearray(), at, False

    def have(self, at: int, n: int) -> bytes:
        self.back(at)
        while at + n - self.base > len(self.held) and self.more():
            pass
        return bytes(self.held[at - self.base : at - self.base + n])

    def find(self, what: bytes, at: int) -> int:
        """Where ``what`` is next, or -1; what was searched is dropped."""
        self.back(at)
        while True:
            i = self.held.find(what, at - self.base)
            if i >= 0:
                return self.base + i
            at = max(at, self.base + len(self.held) - len(what) + 1)
            self.drop(at)
            if not self.more():
                return -1

    def end(self) -> int:
        while self.more():
            self.drop(self.base + len(self.held))
        return self.base + len(self.held)

    def drop(self, at: int) -> None:
        if at - self.base >= READ:
            del self.held[: at - self.base]
            self.base = at


def _inflate(tape: Tape, at: int, most: int | None = None) -> tuple[bytes, int]:
    """The member at ``at`` and where it ends; with ``most`` its first bytes only.

    What inflates to more than HOLD bytes is first worked through without being held, and held if it is whole.
    """
    for hold in (False, True):
        unpack, parts, size, place, step = zlib.decompressobj(31), [], 0, at, 1 << 14
        try:
            while not unpack.eof:
                data = unpack.unconsumed_tail or tape.have(place, step)
                if not data:
                    raise Damage("member ends early")
                before = len(unpack.unconsumed_tail)
                out = unpack.decompress(data, most or READ)
                place += 0 if before else len(data)
                if most and out:
                    return out, place
                size += len(out)
                if hold or size <= HOLD:
                    parts.append(out)
                else:
                    parts.clear()
                    tape.drop(place)
                step = min(2 * step, READ)
        except zlib.error as e:
            raise Damage(f"member does not inflate: {str(e)[:60]}") from None
        if hold or size <= HOLD:
            return b"".join(parts), place - len(unpack.unused_data)
    raise AssertionError


def _plain(tape: Tape, at: int) -> tuple[bytes, int]:
    """The record at ``at`` and where it ends.  One that says it has more than HOLD bytes is worked through first, and
    held only if it ends as it says and its block has the digest that it tells."""
    if tape.have(at, 7) != b"WARC/1.":
        raise Damage("no version line")
    head = tape.have(at, READ)
    stop = head.find(b"\r\n\r\n")
    if stop < 0:
        raise Damage("header without end")
    fields = {x.split(b":", 1)[0].strip().lower(): x.split(b":", 1)[1].strip() for x in head[:stop].split(b"\r\n")[1:] if b":" in x}
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        raise Damage("length missing")
    n = stop + 8 + int(size)
    if n > HOLD:
        sha, place, left = hashlib.sha1(), at + stop + 4, int(size)
        while left:
            data = tape.have(place, min(left, READ))
            if not data:
                raise Damage("record ends early")
            sha.update(data)
            place, left = place + len(data), left - len(data)
            tape.drop(place)
        told = fields.get(b"warc-block-digest")
        if tape.have(place, 4) != b"\r\n\r\n" or told not in (None, b"sha1:" + base64.b32encode(sha.digest())):
            raise Damage("length differs" if told is None else "block digest differs")
    data = tape.have(at, n)
    if len(data) < n:
        raise Damage("record ends early")
    return data, at + n


def _next(tape: Tape, at: int, packed: bool) -> int:
    """Where the next record may begin, from ``at`` on; -1 if nowhere."""
    if not packed:
        while (at := tape.find(b"WARC/1.", at)) >= 0 and tape.have(at + 8, 2) != b"\r\n":
            at += 1
        return at
    while (at := tape.find(b"\x1f\x8b\x08", at)) >= 0:
        try:
            if _inflate(tape, at, 7)[0].startswith(b"WARC/1."[: len(_inflate(tape, at, 7)[0])]):
                return at
        except Damage:
            pass
        at += 1
    return -1


def salvage(stream) -> Iterator[dict]:
    """Every record that holds (kind record), and every stretch of bytes that does not (kind gap)."""
    tape, at = Tape(stream), 0
    packed = not tape.have(0, 5).startswith(b"WARC/")
    while tape.have(at, 1):
        try:
            data, end = _inflate(tape, at) if packed else _plain(tape, at)
            out = {"kind": "record", "begin": at, "end": end} | parse(data)
            at = end
        except Damage as e:
            end = _next(tape, at + 1, packed)
            end = end if end >= 0 else tape.end()
            out = {"kind": "gap", "begin": at, "end": end, "reason": str(e)}
            at = end
        tape.drop(at)
        yield out


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (null in revisits), sha1, size and ``response``: the page to refer to, null for responses.

    Copies are counted by digest before the shuffle.  Payloads that occur twice are sent to the pages if they are few, and no
    payload is shuffled; else they meet by digest, where Spark splits a payload that very many pages have.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).alias("size"))
    twice = rows.filter(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha1", "size", "first")
    twice = written(twice, "twice")
    if twice.count() <= SENT_ROWS:
        twice = F.broadcast(twice)
    joined = rows.join(twice, ["sha1", "size"], "left")
    response = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    # the payload of a revisit is not written: its length is all that the record needs
    return joined.withColumn("response", response).select("page_id", "url", F.when(F.col("response").isNull(), F.col("html")).alias("html"), "sha1", "size", "response")


def write(pages: DataFrame, folder: str | None = None, packed: bool = True, least: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes the archives, of about ``roll`` bytes at most; gives file, bytes, records of each."""
    spark = pages.sparkSession
    ready(spark)
    folder = folder or new_folder(spark, "warc")

    def done(name, size, n):
        return pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    def put(batches):
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for page, url, html, sha1, length, response in zip(*batch.columns):
                if out is None:
                    system, top = store(folder)
                    system.create_dir(top, recursive=True)
                    name, size, n = f"{folder}/pages-{uuid.uuid4().hex}.warc{'.gz' * packed}", 0, 0
                    out = system.open_output_stream(f"{top}/{name.rpartition('/')[2]}", compression=None)
                data = record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), response.as_py(), base64.b32encode(sha1.as_py()).decode(), length.as_py())
                data = member(data) if packed else data
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll:
                    out.close()
                    out = None
                    yield done(name, size, n)
        if out is not None:
            out.close()
            yield done(name, size, n)

    return written(with_roles(pages, least).mapInArrow(put, "file string, bytes long, records long"), "archives")


def read(spark: SparkSession, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of every archive in ``archives`` (column file), one task's work each."""
    ready(spark)
    names = [x.split()[0] for x in OUT.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in OUT.split(", ")])

    def get(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = store(name)
                rows, held = [], 0
                with system.open_input_file(path) as stream:
                    for found in salvage(stream):
                        if not payloads:
                            found["payload"] = None
                        held += len(found.get("payload") or b"")
                        rows.append(found | {"file": name})
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in names], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in names], schema=schema)

    files = archives.select("file")
    n = archives.count()
    return files.repartitionByRange(max(1, n), "file").mapInArrow(get, OUT)
