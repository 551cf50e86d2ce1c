"""Progressive JPEG, coded and decoded for many files at once.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays. Entropy
codes are read in lockstep: every restart interval of every file of a batch is a lane, and one step advances
all lanes by a symbol. Coefficients are inverse-transformed by one matrix product, chroma is upsampled and
planes become full-resolution RGB tensors.

The encoder writes coefficient arrays without loss: a DC scan and two AC bands at half precision, then the
scans that add the lowest bit.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field
from functools import cache, cached_property, lru_cache
from itertools import groupby

import numpy as np

MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


# -- tables


@cache
def zigzag() -> np.ndarray:
    """For each place along the zigzag, its place in an 8 by 8 block: diagonals in turn, every other one upwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


@cache
def inverse_basis() -> np.ndarray:
    """64 by 64: a block's coefficients in zigzag order times this are its samples."""
    n = np.arange(8)
    one = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(1 / 8), 0.5)[None, :]
    return np.kron(one, one).T[zigzag()]


def code_lengths(weights: dict[int, float]) -> tuple[list[int], list[int]]:
    """Counts of codes of 1 to 16 bits and the symbols in code order, by Huffman's rule; the code of ones stays free."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate(weights.items())] + [(min(weights.values()) / 2, len(weights), (-1,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*weights, -1], 0)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
        tick += 1
    deepest = max(depth.values())
    other = next(s for s, d in depth.items() if d == deepest and s != -1) if depth[-1] < deepest else None
    if other is not None:
        depth[other], depth[-1] = depth[-1], deepest
    del depth[-1]
    assert max(depth.values()) <= 16
    symbols = sorted(depth, key=lambda s: (depth[s], s))
    return [sum(d == n for d in depth.values()) for n in range(1, 17)], symbols


def _codes(table: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a table as it stands in a file: 16 counts, then symbols."""
    out, code, at = [], 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            out.append((table[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@cache
def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol << 5 | bits of its code; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, code, bits in _codes(table):
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = symbol << 5 | bits
    return out


@cache
def lookup_values(table: bytes) -> np.ndarray:
    """As lookup(), for a code and its magnitude bits together where both fit into 16 bits: value + 1024 << 12 | run << 8 |
    bits in all; 0 for everything else."""
    e = lookup(table)
    bits, s, r = e & 31, e >> 5 & 15, e >> 9
    fits = (bits > 0) & (s > 0) & (bits + s <= 16)
    ahead = np.arange(1 << 16, dtype=np.int32)
    v = ahead >> np.where(fits, 16 - bits - s, 0) & (1 << s) - 1
    return np.where(fits, _extend(v, s) + 1024 << 12 | r << 8 | bits + s, 0).astype(np.int32)


@cache
def coder(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, c, n in _codes(table):
        code[s], bits[s] = c, n
    return code, bits


@cache
def own_tables() -> dict[str, bytes]:
    """Tables by rule: weights that halve with each step of run length, and with the distance of the size from that of
    letters at half precision."""
    make = lambda w: (lambda n, s: bytes(n) + bytes(s))(*code_lengths(w))
    floor = 2.0**-11
    first = {r << 4 | s: max(floor, 2.0 ** -(2 * r + 1.2 * abs(s - 4))) for r in range(16) for s in range(1, 11)}
    first |= {0x00: 2.0**-4, 0xF0: floor} | {r << 4: floor for r in range(1, 15)}
    refine = {r << 4 | 1: max(floor, 2.0 ** -(3 + r)) for r in range(16)} | {0x00: 1.0, 0xF0: floor} | {r << 4: floor for r in range(1, 15)}
    dc = {s: 2.0 ** -abs(s - 4) for s in range(12)}
    return {"dc": make(dc), "first": make(first), "refine": make(refine)}


# -- layout


@dataclass(frozen=True)
class Layout:
    """Size and sampling factors, (h, v) of each component."""

    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]

    @cached_property
    def most(self) -> tuple[int, int]:
        return max(h for h, _ in self.sampling), max(v for _, v in self.sampling)

    @cached_property
    def mcus(self) -> tuple[int, int]:
        h, v = self.most
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def grid(self, c: int) -> tuple[int, int]:
        """Rows and columns of blocks that the coefficient array of a component has."""
        h, v = self.sampling[c]
        return self.mcus[1] * v, self.mcus[0] * h

    @cached_property
    def _bases(self) -> list[int]:
        out = [0]
        for c in range(len(self.sampling)):
            rows, cols = self.grid(c)
            out.append(out[-1] + rows * cols)
        return out

    def bases(self) -> list[int]:
        """The first block of each component, and the number of blocks."""
        return self._bases


@lru_cache(maxsize=4096)
def _scan_order(layout: Layout, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks in the order of a scan, the component of each, and blocks to a unit of the restart interval."""
    bases = layout.bases()
    if len(components) == 1:
        c = components[0]
        h, v = layout.sampling[c]
        mh, mv = layout.most
        rows, cols = -(-(-(-layout.height * v // mv)) // 8), -(-(-(-layout.width * h // mh)) // 8)
        r, q = np.divmod(np.arange(rows * cols), cols)
        return bases[c] + r * layout.grid(c)[1] + q, np.zeros(rows * cols, np.int64), 1
    mx, my = layout.mcus
    y, x = np.divmod(np.arange(mx * my), mx)
    parts, owner = [], []
    for i, c in enumerate(components):
        h, v = layout.sampling[c]
        for b in range(v):
            for a in range(h):
                parts.append(bases[c] + (y * v + b) * layout.grid(c)[1] + x * h + a)
                owner.append(i)
    return np.stack(parts, 1).ravel(), np.tile(owner, mx * my), len(owner)


@dataclass
class Scan:
    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    dc: tuple[bytes, ...]
    ac: bytes
    restart: int
    data: bytes


@dataclass
class File:
    layout: Layout
    quant: np.ndarray
    comment: bytes
    scans: list[Scan] = field(default_factory=list)


def parse(raw: bytes) -> File:
    """Markers of a progressive file; entropy-coded data stays as it is."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, restart, comment = 2, 0, b""
    quants: dict[int, np.ndarray] = {}
    tables: dict[int, bytes] = {}
    file, ids, which = None, [], []
    while True:
        m = MARKER.search(raw, at)
        if not m:
            raise ValueError("no end of image")
        kind = raw[m.end() - 1]
        if kind == 0xD9:
            break
        n = struct.unpack_from(">H", raw, m.end())[0]
        body, at = raw[m.end() + 2 : m.end() + n], m.end() + n
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide, number = body[k] >> 4, body[k] & 15
                quants[number] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                size = 17 + sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + size]
                k += size
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xC2:
            _, height, width, count = struct.unpack_from(">BHHB", body)
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(count)]
            ids, which = [p[0] for p in parts], [p[2] for p in parts]
            sampling = tuple((p[1] >> 4, p[1] & 15) for p in parts)
            if count == 1:
                sampling = ((1, 1),)
            file = File(Layout(width, height, sampling), np.zeros((count, 64), np.int64), b"")
        elif kind in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive file")
        elif kind == 0xDA:
            count = body[0]
            parts = [body[1 + 2 * i : 3 + 2 * i] for i in range(count)]
            first, last, approx = body[1 + 2 * count : 4 + 2 * count]
            end = MARKER.search(raw, at).start()
            dc = tuple(tables.get(p[1] >> 4, b"") for p in parts) if first == 0 else ()
            ac = tables.get(0x10 | parts[0][1] & 15, b"") if first else b""
            file.scans.append(Scan(tuple(ids.index(p[0]) for p in parts), first, last, approx >> 4, approx & 15, dc, ac, restart, raw[at:end]))
            at = end
    file.comment = comment
    for c, q in enumerate(which):
        file.quant[c] = quants[q]
    return file


# -- entropy decoding, in lockstep


class Bits:
    """Bits of many byte strings one after another, each at a byte's start."""

    def __init__(self, data: list[bytes]) -> None:
        joined = np.frombuffer(b"".join(data) + bytes(2), np.uint8)
        after_ff = np.concatenate([[False], joined[:-1] == 0xFF])
        restarts = np.flatnonzero((joined & 0xF8 == 0xD0) & after_ff)
        drop = np.zeros(len(joined), bool)
        drop[(joined == 0) & after_ff] = True
        drop[restarts] = drop[restarts - 1] = True
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        begin = np.cumsum(sizes) - sizes
        starts = np.sort(np.concatenate([begin, restarts + 1]))
        clean = self.clean = joined[~drop]
        kept = np.cumsum(~drop) - ~drop
        self.of = np.searchsorted(begin, starts, "right") - 1  # the string of each lane
        self.start = 8 * kept[starts]
        x = np.concatenate([clean, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = x[:-3] << np.uint32(24) | x[1:-2] << np.uint32(16) | x[2:-1] << np.uint32(8) | x[3:]

    def single(self) -> np.ndarray:
        """Every bit apart, with some to spare at the end."""
        return np.concatenate([np.unpackbits(self.clean), np.zeros(128, np.uint8)])

    def ahead(self, pos: np.ndarray) -> np.ndarray:
        """At least 25 bits from pos on, at the top of 32."""
        return self.words[pos >> 3] << (pos & 7).astype(np.uint32)


def _take(window: np.ndarray, n: np.ndarray) -> np.ndarray:
    return ((window >> np.uint32(1)) >> (31 - n).astype(np.uint32)).astype(np.int32)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << n >> 1), v - (1 << n) + 1, v)


def _lanes(scans: list[Scan], layouts: list[Layout], bases: list[int], bits: Bits):
    """Places of all scans' blocks, their components, and of each lane its first block and the one after its last."""
    order, owner, lo, hi = [], [], [], []
    total = 0
    counts = np.bincount(bits.of, minlength=len(scans))
    for k, (scan, layout, base) in enumerate(zip(scans, layouts, bases, strict=True)):
        blocks, own, unit = _scan_order(layout, scan.components)
        step = (scan.restart or len(blocks)) * unit
        begin = np.arange(0, len(blocks), step)
        if len(begin) != counts[k]:
            raise ValueError("restart markers do not fit the restart interval")
        order.append(blocks + base)
        owner.append(own)
        lo.append(begin + total)
        hi.append(np.minimum(begin + step, len(blocks)) + total)
        total += len(blocks)
    return np.concatenate(order), np.concatenate(owner), np.concatenate(lo), np.concatenate(hi)


def _dc_first(coef, order, owner, lo, hi, bits, scan) -> None:
    luts = np.stack([lookup(t) for t in scan.dc])
    pos, b, end = bits.start.copy(), lo.copy(), hi
    pred = np.zeros((len(lo), len(scan.dc)), np.int32)
    lane = np.arange(len(lo))
    while len(lane):
        c = owner[b]
        e = luts[c, bits.ahead(pos) >> np.uint32(16)]
        pos = pos + (e & 31)
        s = e >> 5
        pred[lane, c] += _extend(_take(bits.ahead(pos), s), s)
        pos += s
        coef[order[b] * 64] = pred[lane, c] << scan.low
        b = b + 1
        live = b < end
        if not live.all():
            pos, b, end, lane = pos[live], b[live], end[live], lane[live]


def _dc_refine(coef, order, lo, hi, bits, scan) -> None:
    n = hi - lo
    at = np.repeat(bits.start - lo, n) + np.arange(lo[0] if len(lo) else 0, len(order))
    bit = (bits.ahead(at) >> np.uint32(31)).astype(np.int16)
    coef[order * 64] |= bit << scan.low


def _ac_first(coef, order, lo, hi, bits, scan) -> None:
    lut, whole = lookup(scan.ac), lookup_values(scan.ac)
    pos, b, end = bits.start.copy(), lo.copy(), hi
    at = order[b] * 64  # the block's place in coef
    k = np.full(len(lo), scan.first, at.dtype)
    while len(b):
        window = bits.ahead(pos)
        e = whole[window >> np.uint32(16)]
        pos += e & 255
        k += e >> 8 & 15
        rest = np.flatnonzero(e == 0)
        if len(rest):
            # end of block, sixteen zeros, or a long code: read apart; then what was written for these is put right
            e[rest] = 1024 << 12
            keep = k[rest]
            k[rest] = 64  # a place past every band, to be ignored
            inside = k < 64
            i = np.flatnonzero(inside)
            coef[at[i] + k[i]] = ((e[i] >> 12) - 1024) << scan.low
            k[i] += 1
            p, w = pos[rest], window[rest]
            c = lut[w >> np.uint32(16)]
            if not c.all():
                raise ValueError("no such code")
            p += c & 31
            s, r = c >> 5 & 15, c >> 9
            stop = (s == 0) & (r < 15)
            n = np.where(s > 0, s, np.where(stop, r, 0))
            v = _take(bits.ahead(p), n)
            pos[rest] = p + n
            keep += r
            i = np.flatnonzero(s > 0)
            coef[at[rest[i]] + keep[i]] = _extend(v[i], s[i]) << scan.low
            k[rest] = np.where(stop, scan.last + 1, keep + 1)
            i = np.flatnonzero(stop & (r > 0))
            b[rest[i]] += (1 << r[i]) + v[i] - 1
        else:
            coef[at + k] = ((e >> 12) - 1024) << scan.low
            k += 1
        over = np.flatnonzero(k > scan.last)
        if len(over):
            b[over] += 1
            k[over] = scan.first
            if (b[over] < end[over]).all():
                at[over] = order[b[over]] * 64
            else:
                live = b < end
                pos, b, end, k = pos[live], b[live], end[live], k[live]
                at = order[b] * 64


def _refine_block(coef, at, pos, run, put, bits, scan, lut) -> np.ndarray:
    """One block of each lane, from its first code on, place by place; returns the runs of blocks' ends still open.
    at, pos, run and put (of the code just read) are changed in place."""
    one = 1 << scan.low
    eob = np.zeros(len(at), np.int64)
    for k in range(scan.first, scan.last + 1):
        need = np.flatnonzero((run < 0) & (eob == 0))
        if len(need):
            run[need], put[need], eob[need], pos[need] = _refine_code(pos[need], bits, lut, one)
        old = coef[at + k]
        known = old != 0
        bit = (bits.ahead(pos) >> np.uint32(31)).astype(bool) & known
        pos += known
        fresh = ~known & (run == 0)
        run -= ~known & (run >= 0)
        new = old + np.where(bit & (np.abs(old) & one == 0), np.where(old > 0, one, -one), 0)
        coef[at + k] = np.where(fresh, put, new)
    return eob


def _refine_code(pos, bits, lut, one):
    """Read a code at each place: zeros to skip (-1 at an end of block), what to put then, blocks to end, place behind."""
    e = lut[bits.ahead(pos) >> np.uint32(16)]
    if not e.all():
        raise ValueError("no such code")
    pos = pos + (e & 31)
    s, r = e >> 5 & 15, e >> 9
    stop = (s == 0) & (r < 15)
    w = np.where(s > 0, 1, np.where(stop, r, 0))
    v = _take(bits.ahead(pos), w)
    return np.where(stop, -1, r), np.where(s > 0, np.where(v > 0, one, -one), 0), np.where(stop, (1 << r) + v, 0), pos + w


def _ac_refine(coef, order, lo, hi, bits, scan) -> None:
    single = bits.single()
    for s in range(0, len(lo), STRIP):
        _ac_refine_lanes(coef, order, bits.start[s : s + STRIP].copy(), lo[s : s + STRIP], hi[s : s + STRIP], bits, single, scan)


def _ac_refine_lanes(coef, order, pos, lo, hi, bits, single, scan) -> None:
    lut, one = lookup(scan.ac), 1 << scan.low
    b, end = lo.copy(), hi
    eob = np.zeros(len(lo), np.int64)
    rows = coef.reshape(-1, 64)
    while len(b):
        blocks = order[b]
        run, put = np.full(len(b), -1, np.int64), np.zeros(len(b), np.int64)
        need = np.flatnonzero(eob == 0)
        if len(need):
            run[need], put[need], eob[need], pos[need] = _refine_code(pos[need], bits, lut, one)
        # most blocks end with their first code: one bit for each coefficient known already, and nothing else
        plain = np.flatnonzero(run < 0)
        band = rows[blocks[plain], scan.first : scan.last + 1]
        known = band != 0
        rank = np.cumsum(known, axis=1, dtype=np.int32)
        bit = single[pos[plain, None] + (rank - 1)] & known
        add = bit * (np.abs(band) >> scan.low & 1 ^ 1)
        rows[blocks[plain], scan.first : scan.last + 1] = band + (np.sign(band) * add << scan.low)
        pos[plain] += rank[:, -1]
        other = np.flatnonzero(run >= 0)
        if len(other):
            p, r, q = pos[other], run[other], put[other]
            eob[other] = _refine_block(coef, blocks[other] * 64, p, r, q, bits, scan, lut)
            pos[other] = p
        eob = np.maximum(eob - 1, 0)
        b = b + 1
        live = b < end
        if not live.all():
            pos, b, end, eob = pos[live], b[live], end[live], eob[live]


@lru_cache(maxsize=1024)
def _waves(scans: tuple[tuple[tuple[int, ...], int, int], ...]) -> list[int]:
    """scans: components, first and last of each. Scans that touch no coefficient in common may be read at once: how many scans must come before each."""
    out: list[int] = []
    for j, s in enumerate(scans):
        before = [out[i] for i in range(j) if set(scans[i][0]) & set(s[0]) and scans[i][1] <= s[2] and s[1] <= scans[i][2]]
        out.append(max(before, default=-1) + 1)
    return out


def coefficients(files: list[File]) -> list[np.ndarray]:
    """The coefficient array of each file: blocks by component, row and column; 64 in zigzag order."""
    sizes = [f.layout.bases()[-1] for f in files]
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coef = np.zeros(int(begin[-1]) * 64, np.int16)
    alike: dict[tuple, list[tuple[int, Scan]]] = {}
    for i, f in enumerate(files):
        for wave, s in zip(_waves(tuple((s.components, s.first, s.last) for s in f.scans)), f.scans, strict=True):
            alike.setdefault((wave, s.first > 0, len(s.components) > 1, s.first, s.last, s.high, s.low, s.dc, s.ac), []).append((i, s))
    for key in sorted(alike, key=lambda k: k[0]):
        scans = [s for _, s in alike[key]]
        bits = Bits([s.data for s in scans])
        order, owner, lo, hi = _lanes(scans, [files[i].layout for i, _ in alike[key]], [int(begin[i]) for i, _ in alike[key]], bits)
        s = scans[0]
        if s.first == 0:
            if s.high:
                _dc_refine(coef, order, lo, hi, bits, s)
            else:
                _dc_first(coef, order, owner, lo, hi, bits, s)
        elif s.high:
            _ac_refine(coef, order, lo, hi, bits, s)
        else:
            _ac_first(coef, order, lo, hi, bits, s)
    return [coef[64 * a : 64 * b].reshape(-1, 64) for a, b in zip(begin[:-1], begin[1:], strict=True)]


#: Blocks that are transformed, coded or refined at once: what a very large picture takes beyond its own arrays.
STRIP = 1 << 15


def tensor(file: File, coef: np.ndarray) -> np.ndarray:
    """Samples of all components at full resolution, height by width by 3, as RGB; one component stands for all three."""
    lay, bases = file.layout, file.layout.bases()
    mh, mv = lay.most
    across, down = lay.mcus
    out = np.empty((lay.height, lay.width, 3), np.uint8)
    step = max(1, STRIP // (across * mh * mv))
    for top in range(0, down, step):
        rows_of = range(top, min(down, top + step))
        planes = []
        for c, (h, v) in enumerate(lay.sampling):
            cols, rows = lay.grid(c)[1], len(rows_of) * v
            begin = bases[c] + top * v * cols
            values = coef[begin : begin + rows * cols] * file.quant[c].astype(np.float64)
            # a hair above a half, so that a tie falls the same way whatever the order of the sums
            samples = np.clip(np.floor(values @ inverse_basis() + (128.5 + 1e-7)), 0, 255).astype(np.uint8)
            plane = samples.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            planes.append(plane.repeat(mv // v, 0).repeat(mh // h, 1)[:, : lay.width])
        strip = out[top * 8 * mv : (top + len(rows_of)) * 8 * mv]
        if len(planes) == 1:
            strip[:] = planes[0][: len(strip), :, None]
            continue
        y, cb, cr = (p[: len(strip)].astype(np.int32) for p in planes)
        cb, cr = cb - 128, cr - 128
        half = 1 << 15
        for i, channel in enumerate((y + (91881 * cr + half >> 16), y - (22554 * cb + 46802 * cr + half >> 16), y + (116130 * cb + half >> 16))):
            strip[:, :, i] = np.clip(channel, 0, 255)
    return out


# -- encoding


def _pack(value: np.ndarray, bits: np.ndarray, lane: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of all items, lane by lane (items are in order), each lane filled up to a byte by ones: bytes, bytes of each lane."""
    some = bits > 0
    if not some.all():
        value, bits, lane = value[some], bits[some], lane[some]
    end = np.cumsum(bits, dtype=np.int64)
    last = np.flatnonzero(np.concatenate([lane[1:] != lane[:-1], [True]])) if len(lane) else np.zeros(0, np.int64)
    per = np.zeros(n_lanes, np.int64)
    per[lane[last]] = np.diff(end[last], prepend=0)
    size = -(-per // 8)
    start = 8 * (np.cumsum(size) - size)
    pos = end - bits + (start - (np.cumsum(per) - per))[lane]
    out = np.zeros(int(size.sum()) // 4 + 3, np.uint64)
    if len(value):
        word = pos >> 5
        wide = value.astype(np.uint64) << (64 - (pos & 31) - bits).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total = np.add.reduceat(wide, first)
        out[word[first]] += total >> np.uint64(32)
        out[word[first] + 1] += total & np.uint64(0xFFFFFFFF)
    raw = out.astype(">u4").view(np.uint8)[: int(size.sum())].copy()
    fill = 8 * size - per
    last = np.cumsum(size)[fill > 0] - 1
    raw[last] |= ((1 << fill[fill > 0]) - 1).astype(np.uint8)
    return raw, size


def _framed(raw: np.ndarray, size: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Stuff zero bytes after 255, put restart markers between the lanes of a file, and cut by file. lanes: of each file."""
    lane = np.repeat(np.arange(len(size)), size)
    ff = raw == 0xFF
    stuffed = np.cumsum(ff) - ff
    file_of = np.repeat(np.arange(len(lanes)), lanes)
    number = np.arange(len(size)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    marks = np.cumsum(number > 0)  # markers up to and before each lane
    at = np.arange(len(raw)) + stuffed + 2 * marks[lane]
    out = np.zeros(len(raw) + int(ff.sum()) + 2 * int(marks[-1] if len(marks) else 0), np.uint8)
    out[at] = raw
    ffs = np.concatenate([[0], np.cumsum(ff)])
    begin = np.cumsum(size) - size
    lane_at = begin + ffs[begin] + 2 * marks
    later = np.flatnonzero(number)
    out[lane_at[later] - 2] = 0xFF
    out[lane_at[later] - 1] = 0xD0 | (number[later] - 1 & 7)
    cut = lane_at[np.cumsum(lanes) - lanes]
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip(cut, [*cut[1:], len(whole)], strict=True)]


def _size_of(a: np.ndarray) -> np.ndarray:
    """Bits of a non-negative number."""
    return np.frexp(a.astype(np.float32))[1].astype(np.int64)


@cache
def _sizes() -> np.ndarray:
    return _size_of(np.arange(1 << 11)).astype(np.int32)


def _signed_bits(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << s) - 1, v).astype(np.uint64)


def _items_dc(block: np.ndarray, owner: np.ndarray, lane: np.ndarray, table: bytes, low: int):
    v = block[:, 0].astype(np.int64) >> low
    before = np.zeros(len(v), np.int64)
    for c in np.unique(owner):
        at = np.flatnonzero(owner == c)
        before[at[1:]] = np.where(lane[at[1:]] == lane[at[:-1]], v[at[:-1]], 0)
    d = v - before
    s = _size_of(np.abs(d))
    code, bits = coder(table)
    return code[s] << s.astype(np.uint64) | _signed_bits(d, s), bits[s] + s, lane


def _items_first(block: np.ndarray, lane: np.ndarray, table: bytes, first: int, last: int, low: int):
    code, bits = coder(table)
    code, bits = code.astype(np.uint32), bits.astype(np.int32)
    band = block[:, first : last + 1]
    mag = np.abs(band) >> low
    row, k = (x.astype(np.int32) for x in np.nonzero(mag))
    same = np.concatenate([[False], row[1:] == row[:-1]])
    run = k - np.where(same, np.concatenate([[0], k[:-1]]), -1) - 1
    skips = run >> 4
    flat = mag.ravel()
    nz = row * np.int32(band.shape[1]) + k
    m = flat[nz].astype(np.int32)
    s = _sizes()[m]
    symbol = (run & 15) << 4 | s
    value = code[symbol] << s.astype(np.uint32) | np.where(band.ravel()[nz] < 0, (1 << s) - 1 - m, m).astype(np.uint32)
    width = bits[symbol] + s
    final = np.full(len(block), -1)
    final[row] = k  # the last write of a row wins, and rows are in order
    tail = np.flatnonzero(final < last - first)
    ends_before = np.searchsorted(tail, row)  # ends of blocks before this one
    at = np.arange(len(row)) + ends_before + np.cumsum(skips)
    total = len(row) + len(tail) + int(skips.sum())
    v, w, l = np.full(total, code[0xF0]), np.full(total, bits[0xF0]), np.zeros(total, np.int32)
    lane = lane.astype(np.int32)
    v[at], w[at], l[at] = value, width, lane[row]
    zeros = np.repeat(at, skips) - (np.arange(int(skips.sum())) - np.repeat(np.cumsum(skips) - skips, skips)) - 1
    l[zeros] = np.repeat(lane[row], skips)
    upto = np.searchsorted(row, tail, "right")
    skipped = np.concatenate([[0], np.cumsum(skips)])[upto]
    at = upto + skipped + np.arange(len(tail))
    v[at], w[at], l[at] = code[0], bits[0], lane[tail]
    return v, w, l


def _items_refine(block: np.ndarray, lane: np.ndarray, table: bytes, first: int, last: int, low: int):
    code, bits = coder(table)
    band = block[:, first : last + 1]
    mag = (np.abs(band) >> low).astype(np.int16)
    becomes = (mag == 1).any(axis=1)
    plain, fresh = np.flatnonzero(~becomes), np.flatnonzero(becomes)
    # elsewhere, the end-of-block code and the bits of a row, up to 95 in all, as three items
    n_code = int(bits[0])
    single = np.zeros((len(plain), 96), np.uint8)
    single[:, :n_code] = [int(code[0]) >> (n_code - 1 - i) & 1 for i in range(n_code)]
    known = mag[plain] > 1
    row, k = np.nonzero(known)
    count = known.sum(axis=1)
    single[row, n_code + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = mag[plain[row], k] & 1
    w = np.clip((count + n_code)[:, None] - [0, 32, 64], 0, 32)
    v = np.packbits(single, axis=1).view(">u4").astype(np.uint64) >> (32 - w).astype(np.uint64)
    if not len(fresh):
        return v.ravel(), w.ravel(), np.repeat(lane, 3)
    # blocks in which coefficients become non-zero: every code and bit gets its place among those of its block. Bits of known
    # coefficients wait for the next code; of several codes at a coefficient they follow the first
    m = mag[fresh]
    new, some = m == 1, m > 0
    width = m.shape[1]
    k = np.arange(width, dtype=np.int16)
    end = width - 1 - np.argmax(new[:, ::-1], axis=1)
    behind = lambda x: np.concatenate([np.zeros((len(x), 1), x.dtype), x[:, :-1]], 1)
    zeros = np.cumsum(~some, axis=1, dtype=np.int16)
    run = zeros - behind(np.maximum.accumulate(zeros * new, axis=1))
    nth = behind(np.cumsum(new, axis=1, dtype=np.int16))  # codes of new coefficients before
    # codes for sixteen zeros come before a coefficient that is not zero; four bits hold how many a run has had
    coded = some & (k <= end[:, None])
    had = behind(np.maximum.accumulate((nth << 4 | run >> 4) * coded, axis=1))
    long = ((run >> 4) - (had & 15) * (had >> 4 == nth)) * coded
    code_at = np.where((long > 0) | new, k, np.int16(width))
    after = np.concatenate([np.minimum.accumulate(code_at[:, ::-1], axis=1)[:, ::-1][:, 1:], np.full((len(m), 1), width, np.int16)], 1)
    place = lambda at, step, inner: np.asarray(at, np.int64) * 512 + step * 64 + inner
    r1, k1 = np.nonzero(long)
    times = long[r1, k1]
    r1, k1 = np.repeat(r1, times), np.repeat(k1, times)
    nth1 = np.arange(len(r1)) - np.repeat(np.cumsum(times) - times, times)
    r2, k2 = np.nonzero(new)
    symbol = (run[r2, k2].astype(np.int64) & 15) << 4 | 1
    r3, k3 = np.nonzero(m > 1)
    to = after[r3, k3]
    first = (to < width) & (long[r3, np.minimum(to, width - 1)] > 0)
    r4 = np.flatnonzero(end < width - 1)
    row = np.concatenate([fresh[r1], fresh[r2], fresh[r3], fresh[r4], np.repeat(plain, 3)])
    order = np.concatenate([
        place(k1, np.where(nth1 > 0, 2, 0), nth1), place(k2, 3, 0), place(to, np.where(first, 1, 4), k3), np.full(len(r4), int(place(width, 3, 0))), np.tile(np.arange(3), len(plain)),
    ])
    value = np.concatenate([np.full(len(r1), int(code[0xF0])), code[symbol].astype(np.int64) << 1 | (band[fresh[r2], k2] > 0), m[r3, k3] & 1, np.full(len(r4), int(code[0])), v.ravel().astype(np.int64)])
    size = np.concatenate([np.full(len(r1), int(bits[0xF0])), bits[symbol].astype(np.int64) + 1, np.ones(len(r3), np.int64), np.full(len(r4), int(bits[0])), w.ravel()])
    sort = np.argsort(row * (1 << 16) + order, kind="stable")
    return value[sort].astype(np.uint64), size[sort], lane[row[sort]]


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


#: (components, first, last, high, low) of each scan written.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
    *(((c,), 1, 63, 1, 0) for c in range(3)),
)
RESTART = 1


def encode(layouts: list[Layout], arrays: list[np.ndarray], comments: list[bytes], restart: int = RESTART) -> list[bytes]:
    """Files of three components with all quantisers 1; arrays as coefficients() returns them, values of at most ten bits."""
    if not layouts:
        return []
    tables = own_tables()
    sizes = [lay.bases()[-1] for lay in layouts]
    begin = np.cumsum(sizes) - sizes
    coef = np.concatenate(arrays)
    out = []
    for lay, comment in zip(layouts, comments, strict=True):
        frame = struct.pack(">BHHB", 8, lay.height, lay.width, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(lay.sampling))
        head = b"\xff\xd8" + _segment(0xFE, comment) + _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC2, frame)
        head += _segment(0xC4, b"\x00" + tables["dc"] + b"\x10" + tables["first"] + b"\x11" + tables["refine"]) + _segment(0xDD, struct.pack(">H", restart))
        out.append([head])
    for (first, last, high, low), alike in groupby(SCRIPT, key=lambda scan: scan[1:]):
        # scans of several components one after another are coded together: every file's scans in turn
        scans = [comps for comps, *_ in alike]
        order, owner, lane, lanes, base = [], [], [], [], 0
        for comps in scans:
            for lay, a in zip(layouts, begin, strict=True):
                blocks, own, unit = _scan_order(lay, comps)
                order.append(blocks + a)
                owner.append(own)
                lane.append(base + np.arange(len(blocks)) // (restart * unit))
                lanes.append(-(-len(blocks) // (restart * unit)))
                base += lanes[-1]
        order, owner, lane = np.concatenate(order), np.concatenate(owner), np.concatenate(lane)
        # lanes do not depend on each other: code them some at a time
        cuts = [0]
        while cuts[-1] < len(lane):
            cuts.append(int(np.searchsorted(lane, lane[min(cuts[-1] + STRIP, len(lane)) - 1], "right")))
        packed = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            block, own = coef[order[x:y]], lane[x:y] - lane[x]
            if first == 0 and high:
                items = (block[:, 0].astype(np.int64) >> low & 1).astype(np.uint64), np.ones(len(block), np.int64), own
            elif first == 0:
                items = _items_dc(block, owner[x:y], own, tables["dc"], low)
            elif high:
                items = _items_refine(block, own, tables["refine"], first, last, low)
            else:
                items = _items_first(block, own, tables["first"], first, last, low)
            packed.append(_pack(*items, int(own[-1]) + 1))
        raw, size = (np.concatenate([p[i] for p in packed]) for i in range(2))
        framed = _framed(raw, size, np.array(lanes))
        for k, comps in enumerate(scans):
            head = bytes([len(comps)]) + b"".join(bytes([c + 1, 1 if high and first else 0]) for c in comps) + bytes([first, last, high << 4 | low])
            for parts, data in zip(out, framed[k * len(out) : (k + 1) * len(out)], strict=True):
                parts += [_segment(0xDA, head), data]
    return [b"".join([*parts, b"\xff\xd9"]) for parts in out]
