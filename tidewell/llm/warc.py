"""WARC output and input by way of a chunked record table.

A payload is cut into rows (record_id, chunk_no, data) before it leaves the
JVM. Writer and reader see one chunk at a time and carry the digest of all
chunks so far; only the scan of the input holds a whole value. Files are gzip
with one member a record, as is usual for WARC.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, open_fs, shared_dir, small_batches

CHUNK = 64 << 10
#: Payloads under this many bytes are always stored in full.
LEAST_REVISIT = 100

CHUNKS = pa.schema(
    [
        ("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()),
        ("data", pa.binary()), ("digest_so_far", pa.string())
    ]
)
CHUNKS_TYPE = "record_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, chunk_no long, last boolean, data binary, digest_so_far string"


#: Bits of a digest that choose a word of 64 bits in the table of marks, by the number of copies: at most, and fewest.
MOST_MARK_BITS, LEAST_MARK_BITS = 21, 10
#: Copies up to which their table goes to every executor itself (some 30 MB as Spark holds it).
MOST_BROADCAST = 100_000


def mark_bits(copies: int) -> int:
    """So many bits that an eighth of the marks is set at most, up to 16 million copies; beyond that marks fill up, and more payloads are shuffled."""
    return max(LEAST_MARK_BITS, min(MOST_MARK_BITS, copies.bit_length() - 3))


def _marks(marked: DataFrame, bits: int) -> DataFrame:
    """(word, bits): a set bit for each digest in marked, 64 bits a row, 2 ** bits rows at most."""
    word, bit = _mark_of(F.col("key"), bits)
    return marked.select(
        word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")
    ).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _mark_of(digest, bits: int):
    n = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.shiftright(n, 32 - bits), n.bitwiseAND(F.lit(63)).cast("int")


def plan_records(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Add payload, its digest and size, record_type and refers_to to pages (page_id, url, html).

    Copies are found by digest with partial counts first; small payloads have
    keys of their own, so an empty payload that many pages share stays spread.
    The table of copies goes to every executor if it is counted to be small, and
    payloads stay where they are. Else a table of marks, whose size has a fixed
    bound, tells which pages cannot be copies: these stay, and the rest meets the
    table of copies in a shuffle, all of it if marks are crowded.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")
    )
    p = p.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    slim = materialize(p.where(F.col("payload_bytes") >= LEAST_REVISIT).select("record_id", F.col("payload_digest").alias("key")), "warc-digests")
    first = slim.groupBy(F.col("key").alias("first_key")).agg(
        F.min("record_id").alias("first_id"), F.count("*").alias("n")
    ).where("n > 1 and first_id is not null")
    marked = slim.join(materialize(first, "warc-first"), F.col("key") == F.col("first_key")).where("record_id > first_id")
    marked = materialize(marked.select(F.col("record_id").alias("again_id"), "key", "first_id").distinct(), "warc-copies")
    # by digest too: rows that share a page_id can have different payloads
    same = (F.col("record_id") == F.col("again_id")) & (F.col("payload_digest") == F.col("key"))
    again = F.col("first_id").isNotNull()
    columns = [
        "record_id", F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("first_id").alias("refers_to"), "url",
        "payload_bytes", "payload_digest", F.when(~again, F.col("payload")).alias("payload")
    ]
    copies = marked.count()
    if copies <= most_broadcast:
        return p.join(F.broadcast(marked), same, "left").select(*columns)
    bits = mark_bits(copies)
    word, bit = _mark_of(F.col("payload_digest"), bits)
    seen = p.join(F.broadcast(_marks(marked, bits)), word == F.col("word"), "left")
    maybe = F.coalesce(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    met = seen.where(maybe).join(marked, same, "left")
    return met.select(*columns).union(seen.where(~maybe).withColumn("first_id", F.lit(None).cast("long")).select(*columns))


def _cut(records: DataFrame, size: int) -> DataFrame:
    """Rows of the chunked record table but for digest_so_far: cut where the records are, in order. A revisit is one row without data.

    The payload becomes bytes once, before its rows are made, so that a row copies its own chunk alone.
    """
    rows = records.select(*CHUNKS.names[:6], F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("_b"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_b") / size)).cast("int")
    rows = rows.withColumn("_n", n).withColumn("_k", F.explode(F.expr("sequence(0, _n - 1)")))
    data = F.expr(f"substring(_b, _k * {size} + 1, {size})")
    return rows.select(*CHUNKS.names[:6], F.col("_k").cast("long").alias("chunk_no"), (F.col("_k") == F.col("_n") - 1).alias("last"), data.alias("data"))


def _digested(batches):
    """The cut rows as dicts, each with the digest of its record's chunks so far."""
    so_far = None
    for b in batches:
        for row in b.to_pylist():
            if row["record_type"] == "revisit":
                yield row | {"digest_so_far": row["payload_digest"]}
                continue
            if row["chunk_no"] == 0:
                so_far = hashlib.sha256()
            so_far.update(row["data"])
            yield row | {"digest_so_far": so_far.hexdigest()}


def _batched(rows, most: int = 1 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["data"] or b"") + 200
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, CHUNKS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, CHUNKS)


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of planned records."""
    small_batches(records.sparkSession)
    return _cut(records, size).mapInArrow(lambda batches: _batched(_digested(batches)), CHUNKS_TYPE)


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def _head(r: dict) -> bytes:
    http = _http(r["payload_bytes"])
    again = r["record_type"] == "revisit"
    url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <urn:page:{'' if r['record_id'] is None else r['record_id']}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}"
    ]
    if again:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{r['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if again else r['payload_bytes'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


class WarcWriter:
    """Writes the rows of a chunked record table, one chunk at a time."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.uri, self.zip, self.n = fs.open_output_stream(path, compression=None, buffer_size=1 << 20), uri, None, 0

    def add(self, row: dict) -> None:
        if row["chunk_no"] == 0:
            self.zip = zlib.compressobj(4, zlib.DEFLATED, 31)
            self.out.write(self.zip.compress(_head(row)))
            self.n += 1
        self.out.write(self.zip.compress(row["data"]))
        if row["last"]:
            self.out.write(self.zip.compress(b"\r\n\r\n") + self.zip.flush())

    def close(self) -> tuple[str, int]:
        self.out.close()
        return self.uri, self.n


def _write_rows(rows, to: str, file_bytes: int):
    now, size = None, 0
    for row in rows:
        if now is not None and size >= file_bytes and row["chunk_no"] == 0:
            yield now.close()
            now = None
        if now is None:
            now, size = WarcWriter(f"{to}/pages-{uuid.uuid4().hex}.warc.gz"), 0
        now.add(row)
        size += len(row["data"])
    if now is not None:
        yield now.close()


def _files(found):
    for path, n in found:
        yield pa.RecordBatch.from_pylist([{"path": path, "n": n}])


def write(chunks: DataFrame, to: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Write archives of about file_bytes of payload from a chunked record table; return (path, n). A repeated task writes under a new name, so only files named here count."""

    def rows(batches):
        for b in batches:
            yield from b.to_pylist()

    return materialize(chunks.mapInArrow(lambda batches: _files(_write_rows(rows(batches), to, file_bytes)), "path string, n long"), "warc-files")


def write_records(records: DataFrame, to: str, file_bytes: int = 256 << 20, size: int = CHUNK) -> DataFrame:
    """write(chunked(records)) in one worker: each chunk goes into the archive as soon as it comes."""
    small_batches(records.sparkSession)
    return materialize(
        _cut(records, size).mapInArrow(lambda batches: _files(_write_rows(_digested(batches), to, file_bytes)), "path string, n long"),
        "warc-files"
    )


class _Inflated:
    """Read a file of gzip members as one stream, a block at a time."""

    def __init__(self, uri: str, block: int = 1 << 18):
        fs, path = open_fs(uri)
        self.file, self.block, self.inflate, self.buffer, self.raw, self.open = fs.open_input_stream(
            path, compression=None
        ), block, zlib.decompressobj(31), bytearray(), b"", False

    def _more(self) -> bool:
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.file.read(self.block)
            if not self.raw:
                if self.open:
                    raise ValueError("the archive ends inside a record")
                return False
        self.buffer += self.inflate.decompress(self.raw, self.block)
        self.open = not self.inflate.eof
        self.raw = self.inflate.unconsumed_tail if self.open else b""
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the file."""
        at = 0
        while (i := self.buffer.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.buffer[: i + len(mark)])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """n bytes at most, at least one."""
        while not self.buffer:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[: len(out)]
        return out


def records(uri: str, size: int = CHUNK):
    """Rows of the chunked record table of one archive; the payload's digest is checked against the header's."""
    stream = _Inflated(uri)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().strip().split("\r\n")[1:] if ": " in x)
        http = stream.until(b"\r\n\r\n")
        payload = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        left = int(fields["Content-Length"]) - len(http)
        number = lambda name: int(v) if (v := fields.get(name, "")[10:-1]) else None
        row = {
            "record_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
            "url": fields.get("WARC-Target-URI", ""), "payload_bytes": payload,
            "payload_digest": fields["WARC-Payload-Digest"].partition(":")[2]
        }
        if row["record_type"] == "revisit":
            yield row | {"chunk_no": 0, "last": True, "data": b"", "digest_so_far": row["payload_digest"]}
        else:
            so_far, k = hashlib.sha256(), 0
            while left or not k:
                part = bytearray()
                while left and len(part) < size:
                    got = stream.take(min(left, size - len(part)))
                    part += got
                    left -= len(got)
                so_far.update(part)
                if not left and so_far.hexdigest() != row["payload_digest"]:
                    raise ValueError(f"record {row['record_id']} of {uri} fails its digest")
                yield row | {"chunk_no": k, "last": not left, "data": bytes(part), "digest_so_far": so_far.hexdigest()}
                k += 1
        if stream.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError(f"a record of {uri} has a wrong length")


def read(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives; without data, only each record's last row, still checked in full."""
    n = max(1, files.count())

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = records(path)
                yield from _batched(rows if with_data else (r | {"data": None} for r in rows if r["last"]))

    return files.repartition(n).mapInArrow(run, CHUNKS_TYPE)


def archive(pages: DataFrame) -> DataFrame:
    """Write a record per row of pages (page_id, url, html), read the archives back, and return what they hold.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to.
    A null html is an empty payload; empty and other payloads under
    LEAST_REVISIT bytes are always responses; among equal larger payloads the
    smallest page_id is the response, and rows that repeat that page_id are
    responses as well; a null page_id is never a revisit's target; other
    columns are ignored; an empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    files = write_records(plan_records(pages), shared_dir(spark, "warc"))
    return read(files, with_data=False).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
