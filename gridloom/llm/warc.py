"""WARC archives: a writer, and a reader whose tasks scan byte ranges of the files.

Every record is a gzip member of its own. A reading task looks for the gzip magic inside its range, and
takes a place for a member only if its decompressed head is a WARC version line and its whole body has the
length that its header names, and if another member or the file's end follows; the record belongs to the range it starts in, and is read past the range's
end. So a file of any size is read by as many tasks as it has ranges, and no index is needed.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest id holds the
payload and the others are revisits that refer to it.

Defined results: a null payload is empty; empty payloads are written and read like any other; rows that repeat
the largest id of a payload all hold it; a null id is read back as null; a very long payload is one member, read past its
range's end; an empty table writes no file and reads as no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, delete, discard, materialise, new_path, released, tune

MIN_REVISIT = 1000
MAGIC = b"\x1f\x8b\x08"
#: A task reads the records that start in this many bytes; a writer begins a new file beyond FILE_BYTES.
RANGE_BYTES, FILE_BYTES = 8 << 20, 64 << 20
READ_BYTES = 1 << 20


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """id, url, payload, digest, refers_to (null for those that hold their payload)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    small = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload")).where(F.octet_length("payload") >= min_bytes)
    keep = small.groupBy(F.sha1("payload").alias("digest")).agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep")
    # the payloads move once here; a payload that many pages share is split by the adaptive skew join
    joined = rows.join(keep, "digest", "left")
    refers = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("keep")), F.col("keep"))
    return joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed record."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """pages as from revisits(). Each task writes files of its own, whose names no other attempt uses; the manifest,
    which is kept before anything reads it, names those of the attempts that counted."""
    tune(pages.sparkSession)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        for rb in batches:
            for row in zip(*(rb.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                raw = record(*row)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield batch({"path": [path.rpartition("/")[2]], "bytes": [size], "records": [n]}, MANIFEST)
        if out is not None:
            out.close()
            yield batch({"path": [path.rpartition("/")[2]], "bytes": [size], "records": [n]}, MANIFEST)

    return materialise(pages.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, bytes bigint, records bigint"), "manifest")


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and body of a decompressed record; None if it is no whole record."""
    if not data.startswith(b"WARC/1."):
        return None
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        return None
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    n = headers.get("Content-Length", "")
    if not n.isdigit() or len(rest) != int(n) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return headers, rest[: int(n)]


def records_in(source: io.IOBase, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records whose first byte lies in [start, end): place, headers, body."""
    source.seek(start)
    held, base, more = b"", start, True

    def fill(upto: int) -> None:
        nonlocal held, more
        parts = [held]
        have = len(held)
        while more and base + have < upto:
            part = source.read(max(READ_BYTES, upto - base - have))
            more = len(part) > 0
            parts.append(part)
            have += len(part)
        held = b"".join(parts)

    at = start
    while at < end:
        fill(min(end + len(MAGIC), at + READ_BYTES))
        hit = held.find(MAGIC, at - base)
        if hit < 0 or base + hit >= end:
            if base + len(held) >= end + len(MAGIC) or not more:
                return
            at = max(at, base + len(held) - len(MAGIC) + 1)
            held, base = held[at - base :], at
            continue
        held, base = held[hit:], base + hit
        at = base
        got, used = _member(lambda n: (fill(base + n), held)[1])
        fill(base + used + len(MAGIC))
        follows = held[used : used + len(MAGIC)]
        if got is None or not (follows == MAGIC or not follows):  # a member inside another's stored bytes is followed by the rest of those
            at += 1
            continue
        yield at, *got
        at += used
        held, base = held[used:], at


def _member(bytes_upto) -> tuple[tuple[dict[str, str], bytes] | None, int]:
    """Decode the member at the front of what bytes_upto(n) returns, reading on as needed; give up as soon as its
    head is no WARC head."""
    reader, out, fed, want = zlib.decompressobj(31), bytearray(), 0, 1 << 16
    while True:
        data = bytes_upto(want)
        part = data[fed:want]
        if not part:
            return None, 0
        try:
            out += reader.decompress(part)
        except zlib.error:
            return None, 0
        fed += len(part)
        if not b"WARC/1.".startswith(bytes(out[:7])):
            return None, 0
        if reader.eof:
            got = parse(bytes(out))
            return got, fed - len(reader.unused_data)
        want += max(1 << 18, want // 2)  # geometric, so that a long member is copied a few times only


READ = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _id(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def read(spark: SparkSession, manifest: DataFrame, folder: str, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each record. A response's digest and length are those of the payload read; a revisit's are those
    that its header names. Without payloads, these stay in the task that read them."""
    tune(spark)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", starts.alias("start"))
    schema = READ if with_payload else pa.schema([f for f in READ if f.name != "payload"])

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for rb in batches:
            for path, start in zip(rb.column("path").to_pylist(), rb.column("start").to_pylist(), strict=True):
                cols: dict[str, list] = {f.name: [] for f in schema}
                held = 0
                with fs.open_input_file(f"{root}/{path}") as source:
                    for _, head, body in records_in(source, start, start + range_bytes):
                        response = head["WARC-Type"] == "response"
                        row = {
                            "id": _id(head["WARC-Record-ID"]),
                            "url": head.get("WARC-Target-URI", ""),
                            "record_type": head["WARC-Type"],
                            "digest": hashlib.sha1(body).hexdigest() if response else head["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "payload_bytes": len(body) if response else int(head["WARC-Payload-Length"]),
                            "refers_to": None if response else _id(head["WARC-Refers-To"]),
                            "payload": body if response else None,
                        }
                        for c in cols:
                            cols[c].append(row[c])
                        held += len(body) + 200 if with_payload else 200
                        if held > 4_000_000:
                            yield batch(cols, schema)
                            cols, held = {f.name: [] for f in schema}, 0
                yield batch(cols, schema)

    ddl = "id bigint, url string, record_type string, digest string, payload_bytes bigint, refers_to bigint" + ", payload binary" * with_payload
    # a range is about a task's work, whatever file it is of, and there are as many tasks as ranges
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(int(n)).mapInArrow(released(run), ddl)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write pages (page_id, url, html) into the shared folder: the manifest and the folder."""
    folder = new_path(pages.sparkSession, "warc")
    return write(revisits(pages), folder), folder


def remove(manifest: DataFrame, folder: str) -> None:
    """Delete an archive once nothing reads it any more."""
    discard(manifest)
    delete(manifest.sparkSession, folder)
