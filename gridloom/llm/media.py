"""Texts as media columns: payloads kept without loss in the coefficients of progressive JPEG files, and read back.

A payload is a text's UTF-8 bytes, filled up by bytes 255 to a positive multiple of ``UNIT``. Each byte less 128 is one
DCT coefficient, the format's unit; blocks of 64 fill the luma plane, then the two chroma planes at half
resolution, and blocks beyond the payload are zero. Reading decodes every scan, takes the payload from the coefficient
arrays, and makes the full-resolution RGB tensor.

Defined results: null and empty texts have a payload of UNIT bytes 255; equal texts have equal files and tensors;
repeated rows are coded each; a very long text is one large picture, coded in strips; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import progressive as P
from .common import batch, blocks, dealt, released, texts_of, tune

UNIT = 576
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: Bytes of payloads coded at once.
BLOCK_BYTES = 2 << 20


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes before filling up, and the payload."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def layout_of(n_blocks: int) -> P.Layout:
    units = -(-n_blocks // 6)
    across = min(int(np.ceil(np.sqrt(units))), 4095)
    return P.Layout(16 * across, 16 * -(-units // across), SAMPLING)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    layouts, arrays = [], []
    for p in payloads:
        lay = layout_of(len(p) // 64)
        array = np.zeros((lay.bases()[-1], 64), np.int16)
        array[: len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - 128
        layouts.append(lay)
        arrays.append(array)
    return P.encode(layouts, arrays, [b"payload=%d" % len(p) for p in payloads])


def decode_media(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Of each file its payload and its RGB tensor."""
    parsed = [P.parse(f) for f in files]
    out = []
    for file, coef in zip(parsed, P.coefficients(parsed), strict=True):
        n = int(file.comment.removeprefix(b"payload=")) if file.comment.startswith(b"payload=") else 0
        payload = (coef[: n // 64] + 128).astype(np.uint8).tobytes()
        out.append((payload, P.tensor(file, coef)))
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, means of the channels and a checksum of the tensor."""
    total = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (rgb.shape[0] * rgb.shape[1])
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(f"{m:.4f}" for m in total) + f":{zlib.crc32(rgb.tobytes()):08x}"


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the stored form of each text."""
    tune(docs.sparkSession)

    def run(batches):
        for rb in batches:
            got = [payload_of(t) for t in texts_of(rb.column("text"))]
            ids = rb.column("id")
            for a, b in blocks((len(p) for _, p in got), BLOCK_BYTES):
                yield batch({"doc_id": ids.slice(a, b - a), "n_bytes": [n for n, _ in got[a:b]], "media": encode_payloads([p for _, p in got[a:b]])}, STORED)

    return dealt(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(released(run), "doc_id bigint, n_bytes bigint, media binary")


def tensors(stored: DataFrame, with_tensors: bool = True) -> DataFrame:
    """What the stored form holds: payload and RGB tensor (height, width, 3 bytes a pixel), or with_tensors=False their digests only."""
    tune(stored.sparkSession)
    digest = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    whole = [("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())]
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *digest, *(whole if with_tensors else [])])
    ddl = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    ddl += ", payload binary, height int, width int, rgb binary" * with_tensors

    def run(batches):
        for rb in batches:
            files = rb.column("media").to_pylist()
            for a, b in blocks(map(len, files), BLOCK_BYTES):
                cols: dict = {f.name: [] for f in schema}
                cols |= {"doc_id": rb.column("doc_id").slice(a, b - a), "n_bytes": rb.column("n_bytes").slice(a, b - a)}
                for file, (payload, rgb) in zip(files[a:b], decode_media(files[a:b]), strict=True):
                    row = {
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-32:]),
                        "media_bytes": len(file),
                        "media_sha256": hashlib.sha256(file).hexdigest(),
                        "feature": feature(rgb),
                    }
                    if with_tensors:
                        row |= {"payload": payload, "height": rgb.shape[0], "width": rgb.shape[1], "rgb": rgb.tobytes()}
                    for c, v in row.items():
                        cols[c].append(v)
                yield batch(cols, schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(released(run), ddl)
