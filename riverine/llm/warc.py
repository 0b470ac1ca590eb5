"""WARC archives compressed with Zstandard: writing and reading.

An archive is a leading skippable frame (magic 184D2A5D) that holds the
dictionary, itself a zstd frame, then one zstd frame per WARC record.  The
reader takes the dictionary from that frame, decodes one frame per record and
validates version line, headers, lengths and digests.

Of records with equal payloads of at least min_bytes the one with the largest
page_id is the response; the others are revisit records without payload that
refer to it.  Smaller ones are responses.

Cases: null html is an empty payload; a null page_id is written and read as
"null" and comes back null; rows that repeat with the same page_id and payload
stay responses all if theirs is the largest page_id; an empty table gives no
archive and no rows; other columns aren't read, null urls become empty.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote, unquote

import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import pieces, smallest, written

MAGIC = 0x184D2A5D
#: First bytes of each zstd frame.
FRAME = b"\x28\xb5\x2f\xfd"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


def record(page_id, url: str, kind: str, refers_to, size: int, digest: str, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], dictionary: bytes, level=3) -> bytes:
    """One archive file; an empty dictionary leaves the leading frame out."""
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    head = b""
    if dictionary:
        body = zstandard.ZstdCompressor(level=level).compress(dictionary)
        head = struct.pack("<II", MAGIC, len(body)) + body
    return head + b"".join(map(packer.compress, records))


def frames(data: bytes):
    """The records of an archive, each decoded from a frame of its own."""
    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary frame is cut short")
        body = data[8 : 8 + size]
        if body.startswith(FRAME):
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        trained, at = zstandard.ZstdCompressionDict(body), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=trained)
    view = memoryview(data)
    while at < len(data):
        one = reader.decompressobj()
        parts, step = [], 1 << 16
        try:
            while not one.eof:
                if at >= len(data):
                    raise WarcError("a frame is cut short")
                chunk = view[at : at + step]
                parts.append(one.decompress(chunk))
                at += len(chunk)
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """(page_id, url, kind, refers_to, size, digest, payload) of a record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC record: {data[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise WarcError(f"headers are missing: {sorted(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"Content-Length {fields['content-length']} doesn't fit {len(rest) - 4} bytes")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not sep or size is None or kind not in ("response", "revisit"):
        raise WarcError(f"a {kind} record without HTTP length")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("the payload isn't that of its length and digest")
    if kind == "revisit" and payload:
        raise WarcError("a revisit record with a payload")

    def number(key):
        x = fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x not in ("", "null") else None

    return number("warc-record-id"), unquote(fields.get("warc-target-uri", "")), kind, number("warc-refers-to"), size, digest, payload if kind == "response" else None


def train_dictionary(pages: DataFrame, id_col="page_id", html_col="html", samples=200, size=32_768, slice_chars=4096) -> bytes:
    """A zstd dictionary of a bounded sample: a slice of each of the pages with the smallest id hash, begun at a place
    that the hash says, so that all parts of pages are seen.  The sample is drawn on ids, so pages without html lessen it; too
    few: none.  No result depends on it but archive sizes."""
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("x") - slice_chars, F.lit(0)) + 1) + 1
    ids = pages.select(F.col(html_col).alias("x"), F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 63) - 1)).alias("h"), F.lit(0).alias("one"))
    part = smallest(ids, "one", samples).where("x != ''").select(F.col("x").substr(start.cast("int"), F.lit(slice_chars)).alias("x"), "h").limit(4 * samples)
    found = [r["x"].encode() for r in sorted(part.collect(), key=lambda r: (r["h"], r["x"]))[:samples]]
    try:
        return zstandard.train_dictionary(size, found).as_bytes() if len(found) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", min_bytes=1000, archive_bytes=8 << 20, level=3, dictionary: bytes | None = None, most_broadcast=200_000) -> DataFrame:
    """(archive string, content binary), each a whole .warc.zst of about archive_bytes of records at most.

    (digest, page_id) is shuffled to find the response of each payload that
    occurs more than once, combined before the shuffle, so that thousands of
    equal payloads meet as one row per task.  Those responses are counted: up
    to most_broadcast of them (20 bytes of digest and an id each) are
    broadcast, and no html moves; beyond, pages are joined with them by digest,
    which shuffles the html of all pages of at least min_bytes.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8")))).withColumn("size", F.octet_length("html").cast("long"))
    if dictionary is None:
        dictionary = train_dictionary(pages, id_col, html_col)
    first = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "responses")
    if first.count() <= most_broadcast:
        rows = rows.join(F.broadcast(first), "digest", "left")
    else:
        large = F.col("size") >= min_bytes
        rows = rows.where(large).join(first, "digest", "left").unionByName(rows.where(~large).withColumn("first", F.lit(None).cast("long")))
    rows = rows.withColumn("refers_to", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")))
    rows = rows.select("page_id", "url", "digest", "size", "refers_to", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, held, weight = TaskContext.get().partitionId(), 0, [], 0
        for batch in pieces(batches):
            for r in zip(*(batch.column(x).to_pylist() for x in ("page_id", "url", "digest", "size", "refers_to", "html")), strict=True):
                page_id, url, digest, size, refers_to, html = r
                held.append(record(page_id, url or "", "response" if html is not None else "revisit", refers_to, size, digest.hex(), (html or "").encode()))
                weight += len(held[-1])
                if weight >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [f"part-{part:05d}-{number:05d}.warc.zst"], "content": [archive(held, dictionary, level)]})
                    number, held, weight = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": [f"part-{part:05d}-{number:05d}.warc.zst"], "content": [archive(held, dictionary, level)]})

    return rows.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame, content_col="content", with_payload=True) -> DataFrame:
    """Records of archives; use spark.read.format("binaryFile") for files, whose column is content too."""

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for data in frames(content or b""):
                    rows.append(parse(data) if with_payload else (*parse(data)[:-1], None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return archives.select(F.col(content_col).alias("content")).mapInArrow(run, READ)


def warc_roundtrip(pages: DataFrame, **kinds) -> DataFrame:
    """Writes the archives to a table in the shared folder and reads every record back."""
    return read_archives(written(write_archives(pages, **kinds), "warc"), with_payload=False)
