"""SentencePiece encoding and decoding that keep offsets.

A text is normalised by the longest prefix found in the model's compiled character map, a double-array trie,
and every byte of the normalised text remembers the byte of the original it came from. Merges are the
library's, on the normalised text: where no piece has a space mark after another character, merges cannot
cross into a word, so each distinct word is encoded once. Each piece is projected through the alignment to
a byte range of the original.

Defined results: null and empty texts have no pieces and decode to the empty text; every other text's
pieces cover it without gaps but for what the character map drops. Of a character spelled in byte pieces, the
last has the character's range and the others are empty ranges at its start. Repeated rows are encoded each; texts of any
length are taken whole; an empty table gives no rows; extra columns, whatever their names, are ignored. Ids are decoded by
the library's own ``decode``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, dealt, released, texts_of, tune

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_MARK = SPACE.encode()


def _fields(raw: bytes):
    """(number, value, bytes of the whole field) of a serialised message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        begin = at
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = raw[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            value = raw[at : at + n]
            at += n
        yield tag >> 3, value, raw[begin:at]


class CharacterMap:
    """The compiled map: the size of a double array, its units, then replacement strings that end in zero bytes."""

    def __init__(self, blob: bytes) -> None:
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if blob else []
        self.strings = blob[4 + n :] if blob else b""

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of raw[at:] in the map, and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        node = _jump(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= _jump(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(0, start)]


def _jump(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


@dataclass
class Encoded:
    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    ids_text: str
    decoded: str


class Table:
    """What is known of each word: its pieces' ids and byte ranges in flat arrays, and strings."""

    def __init__(self) -> None:
        self.ids = self.begin = self.end = self.starts = self.counts = self.sizes = np.zeros(0, np.int64)
        self.ids_text: list[str] = []
        self.shown: list[str] = []

    def append(self, ids, begin, end, counts, sizes, ids_text, shown) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.begin, self.end = (np.concatenate(x) for x in ((self.ids, ids), (self.begin, begin), (self.end, end)))
        self.counts, self.sizes = np.concatenate([self.counts, counts]), np.concatenate([self.sizes, sizes])
        self.ids_text += ids_text
        self.shown += shown


class PieceModel:
    def __init__(self, raw: bytes) -> None:
        import sentencepiece

        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        spec: dict[int, object] = {}
        rest = []
        for number, value, whole in _fields(raw):
            if number == 1:
                piece = {n: v for n, v, _ in _fields(value)}
                self.pieces.append(piece.get(1, b""))
                self.kinds.append(piece.get(3, NORMAL))
            if number == 3:
                spec = {n: v for n, v, _ in _fields(value)}
            else:
                rest.append(whole)
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.user = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER), key=len, reverse=True)
        plain = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00\x28\x00"  # no map, no dummy prefix, spaces as they are
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + bytes([len(plain)]) + plain)
        inside = re.compile(f"[^{SPACE}]{SPACE}".encode())
        self.by_word = self.escape and not any(inside.search(p) or SPACE in p.decode("utf-8", "replace").lstrip(SPACE) for p in self.pieces)
        self._word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._known: dict[str, int] = {}
        self._table = Table()
        self.widths = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.odd = np.array([k in (UNKNOWN, BYTE) for k in self.kinds])
        self._plain = [None if k in (UNKNOWN, BYTE, CONTROL) else p.decode("utf-8", "replace").replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds, strict=True)]

    # -- normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the original that it stands for."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return "", np.zeros(1, np.int64)
        mark = _MARK if self.escape else b" "
        if not self.map.units and not self.squeeze and not self.user:
            width = np.ones(len(raw) + 1, np.int64)
            if self.escape:
                width[:-1][np.frombuffer(raw, np.uint8) == 32] = len(mark)
            align = np.repeat(np.arange(len(raw) + 1), width)
            if self.dummy:
                align = np.concatenate([np.zeros(len(mark), np.int64), align])
            return (mark.decode() if self.dummy else "") + (text.replace(" ", SPACE) if self.escape else text), align
        at, out, align = 0, bytearray(), []
        if self.squeeze:
            while at < len(raw) and self._prefix(raw, at)[1] == b" ":
                at += self._prefix(raw, at)[0]
            if at == len(raw):
                return "", np.array([len(raw)])
        if self.dummy:
            out += mark
            align += [at] * len(mark)
        spaced = self.squeeze
        while at < len(raw):
            n, put = self._prefix(raw, at)
            if spaced:
                put = put.lstrip(b" ")
            if put:
                shown = put.replace(b" ", mark) if self.escape else put
                out += shown
                align += [at] * len(shown)
                spaced = put.endswith(b" ")
            at += n
            spaced = spaced and self.squeeze
        if self.squeeze:
            while out.endswith(mark):
                at = align[len(out) - len(mark)]
                del out[len(out) - len(mark) :]
        return out.decode("utf-8"), np.array([*align[: len(out)], at])

    def _prefix(self, raw: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.user:
            if raw.startswith(symbol, at):
                return len(symbol), symbol
        hit = self.map.longest(raw, at)
        if hit:
            return hit
        first = raw[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, raw[at : at + n]

    # -- words

    def _sizes(self, word: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Of each piece of a word: the normalised bytes before its begin and before its end."""
        begin, end, at = [], [], 0
        raw = word.encode("utf-8", "surrogatepass")
        k = 0
        while k < len(ids):
            kind = self.kinds[ids[k]]
            if kind == BYTE:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                begin += [at] * n
                end += [at] * (n - 1) + [at + n]
                at += n
                k += n
            else:
                n = len(self.pieces[ids[k]]) if kind != UNKNOWN else self._unknown(raw, at, ids, k)
                begin.append(at)
                at += n
                end.append(at)
                k += 1
        return begin, end

    def _unknown(self, raw: bytes, at: int, ids: list[int], k: int) -> int:
        """Bytes under an unknown piece: up to where the next known one stands."""
        if k + 1 == len(ids):
            return len(raw) - at
        return raw.index(self.pieces[ids[k + 1]], at + 1) - at

    def _learn(self, words: list[str]) -> None:
        """Give every word of the list a row in the table of words."""
        if len(self._known) > 300_000:
            self._known, self._table = {}, Table()
        known = self._known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if not new:
            return
        first = len(known)
        known.update(zip(new, range(first, first + len(new)), strict=True))
        encoded = self.merger.encode(new, num_threads=1)
        counts = np.fromiter(map(len, encoded), np.int64, len(new))
        ids = np.fromiter((i for e in encoded for i in e), np.int64, int(counts.sum()))
        end = np.cumsum(self.widths[ids])
        last = np.cumsum(counts)
        sizes = np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in new), np.int64, len(new))
        before = np.concatenate([[0], end])[last - counts]
        end -= np.repeat(before, counts)
        begin = end - self.widths[ids]
        for k in np.unique(np.repeat(np.arange(len(new)), counts)[self.odd[ids]]):
            b, e = self._sizes(new[k], encoded[k])
            begin[last[k] - counts[k] : last[k]], end[last[k] - counts[k] : last[k]] = b, e
        self._table.append(ids, begin, end, counts, sizes, [",".join(map(str, e)) for e in encoded], [self._shown(e) for e in encoded])

    def encode_all(self, texts: list[str]) -> list[Encoded]:
        normal = [self.normalise(t) for t in texts]
        split = [(self._word.findall(n) if self.by_word else [n]) if n else [] for n, _ in normal]
        self._learn([w for words in split for w in words])
        known, table, out = self._known, self._table, []
        rows = np.fromiter((known[w] for words in split for w in words), np.int64, sum(map(len, split)))
        counts = table.counts[rows]
        stop = np.cumsum(counts)
        flat = np.arange(stop[-1] if len(stop) else 0) + np.repeat(table.starts[rows] - (stop - counts), counts)
        ids = table.ids[flat]
        at = np.cumsum(table.sizes[rows]) - table.sizes[rows]  # within all normalised texts of the block
        shift = np.repeat(at, counts)
        begin, end = table.begin[flat] + shift, table.end[flat] + shift
        word, token, byte = 0, 0, 0
        rows = rows.tolist()
        for (_, align), words in zip(normal, split, strict=True):
            w = word + len(words)
            t = int(stop[w - 1]) if w else 0
            shown = "".join([table.shown[r] for r in rows[word:w]])
            if self.dummy and shown.startswith(" "):
                shown = shown[1:]
            out.append(Encoded(ids[token:t], align[begin[token:t] - byte], align[end[token:t] - byte], ",".join([table.ids_text[r] for r in rows[word:w]]), shown))
            word, token, byte = w, t, byte + len(align) - 1 if words else byte
        return out

    # -- decoding

    def _shown(self, ids: list[int]) -> str:
        """Text of the ids, with the space that stands for the dummy prefix still before it."""
        plain = [self._plain[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out, held = [], bytearray()

        def flush() -> None:
            if held:
                out.append(_valid(bytes(held)))
                held.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(self._plain[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        shown = self._shown(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return shown[1:] if self.dummy and first is not None and self.pieces[first].startswith(_MARK) else shown


def _valid(raw: bytes) -> str:
    """UTF-8 with each byte that starts no character as a replacement character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@cache
def model_at(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _by_blocks(texts: list[str], limit: int = 1_000_000):
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begin", pa.list_(pa.int32())), ("end", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and for each id the byte range [begin, end) of the original text."""
    tune(docs.sparkSession)

    def run(batches):
        model = model_at(path)
        for rb in batches:
            texts, doc_ids = texts_of(rb.column("text")), rb.column("id")
            for a, b in _by_blocks(texts):
                got = model.encode_all(texts[a:b])
                yield batch({"doc_id": doc_ids.slice(a, b - a), "ids": [g.ids for g in got], "begin": [g.begin for g in got], "end": [g.end for g in got]}, ENCODED)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, begin array<int>, end array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        model = model_at(path)
        for rb in batches:
            yield batch({"doc_id": rb.column("doc_id"), "text": model.library.decode([ids or [] for ids in rb.column("ids").to_pylist()])}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode() and decode() in one pass, with digests in place of the ids, the byte ranges and the decoded text."""
    tune(docs.sparkSession)

    def run(batches):
        model = model_at(path)
        for rb in batches:
            texts, doc_ids = texts_of(rb.column("text")), rb.column("id")
            for a, b in _by_blocks(texts):
                got = model.encode_all(texts[a:b])
                decoded = model.library.decode([g.ids.tolist() for g in got])
                yield batch(
                    {
                        "doc_id": doc_ids.slice(a, b - a),
                        "n_tokens": [len(g.ids) for g in got],
                        "ids_sha256": [hashlib.sha256(g.ids_text.encode()).hexdigest() for g in got],
                        "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded],
                        "spans_crc32": [zlib.crc32(g.end.astype("<i4").tobytes(), zlib.crc32(g.begin.astype("<i4").tobytes())) for g in got],
                    },
                    DIGESTS,
                )

    return dealt(docs.select(F.col("doc_id").cast("long").alias("id"), "text")).mapInArrow(released(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint")
