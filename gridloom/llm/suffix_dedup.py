"""Exact removal of repeated passages: every byte covered by a ``DEPTH``-byte string that starts at more than one place.

Each window of DEPTH bytes belongs to the anchor with the least hash among its GRAM-byte strings, so equal
windows have equal anchors wherever they stand. An anchor's run of windows with the bytes they span is a
context. Hashes only deal the work: anchors that occur once cannot repeat and are left out, and contexts go to
tasks by their anchor. A context that occurs at many places sends the bytes of two of them, so copies cost a row
for each map task. In its task, each batch of contexts gets a suffix array, is merge-scanned against
those of the task, and arrays of equal size merge (``suffix_family``); suffixes that are equal there are the
repeated windows.

An anchor with many different contexts would crowd one task. Those contexts are dealt more finely: first by
the bytes that sixteen neighbouring windows share, then by single windows; at each grain suffix arrays
decide, as before, and no row is left out that could match.

``SuffixIndex`` keeps the family in the shared folder between calls: contexts, and for each grain the levels'
arrays in buckets of bounded size. A new batch of documents brings its contexts of anchors seen before, and older
contexts that now have company; their arrays are merge-scanned against each stored level, and levels of
equal size are merged. ``spans`` and ``strip`` are such an index of one batch, of which nothing is kept.

Defined results: null and empty texts and texts shorter than DEPTH lose nothing of their own; texts of any length are
read in chunks of CHUNK windows, with equal results; repeated rows repeat each other, so they lose every byte if they
have DEPTH bytes; an empty table gives no rows; extra columns are ignored by ``spans`` and passed through by ``strip``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, dealt, discard, materialise, new_path, released, tune
from .suffix_family import WORD, Level, SuffixFamily, merged, scan

DEPTH, GRAM = 200, 64
#: Windows hashed at once; positions within them take the low bits of an anchor's order.
CHUNK = 1 << 18
POSITION = np.uint64((1 << 22) - 1)
#: An anchor with more different contexts than this is dealt at the next finer grain: windows to a cell of each.
MOST_CONTEXTS = 2000
CELLS = (16, 1)
#: Bytes of contexts in a bucket of the arrays, and in one batch of a task.
TASK_BYTES, BATCH_BYTES = 4_000_000, 1_000_000

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of base and of its inverse modulo 2**64."""
    values = np.random.default_rng(base).integers(0, 1 << 64, 256, dtype=np.uint64)
    n = CHUNK + 2 * DEPTH
    up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])
    down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))])
    return values, up, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _prefix(x: np.ndarray, base: int) -> np.ndarray:
    values, up, _ = _powers(base)
    return np.concatenate([[np.uint64(0)], np.cumsum(values[x] * up[: len(x)])])


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Of the strings [start, end): the same wherever they stand."""
    return _mix((prefix[end] - prefix[start]) * _powers(base)[2][start] + (end - start).astype(np.uint64))


def chunks(raw: bytes):
    """Parts of at most CHUNK windows with all the bytes of their windows: offset, bytes."""
    for a in range(0, max(len(raw) - DEPTH + 1, 0), CHUNK):
        yield a, raw[a : a + CHUNK + DEPTH - 1]


def anchors(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the windows of x that are valid: key and name of each anchor's context, its first window, the anchor, the number of windows."""
    one = _prefix(x, _BASES[0])
    n = len(x) - GRAM + 1
    at = np.arange(n, dtype=np.int64)
    h = _mix((one[GRAM:] - one[:-GRAM]) * _powers(_BASES[0])[2][:n])
    order = (h & ~POSITION) | at.astype(np.uint64)
    w = DEPTH - GRAM + 1
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = order
    padded = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    q = np.flatnonzero(valid[: len(x) - DEPTH + 1])
    p = (np.minimum(behind[q], ahead[q + w - 1]) & POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1] + 1)])) if len(q) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(q)]]))
    q0, p0 = q[first], p[first]
    name = _hash(_prefix(x, _BASES[1]), q0, q0 + count + DEPTH - 1, _BASES[1])
    return h[p0].view(np.int64), name.view(np.int64), q0, p0, count


OCC = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("crc", pa.int64()), ("q0", pa.int32()), ("lead", pa.int16()), ("nq", pa.int16())])
OCC_DDL = "key bigint, ctx bigint, doc bigint, crc bigint, q0 int, lead smallint, nq smallint"


def _digest(text):
    """A second name of a row beside its id, for rows that repeat an id."""
    return F.xxhash64(text)


def _rows(docs: DataFrame) -> DataFrame:
    """doc, crc, raw: the two name a row; rows that agree in both have one text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), _digest(text).alias("crc"), text.alias("raw"))


def _occurrences(rows: DataFrame, key_only: bool) -> DataFrame:
    schema = pa.schema([OCC.field("key")]) if key_only else OCC

    def run(batches):
        for rb in batches:
            docs, crcs = (rb.column(c).to_numpy() for c in ("doc", "crc"))
            raws = rb.column("raw")
            parts = [(i, a, part) for i in range(rb.num_rows) for a, part in chunks(raws[i].as_py())]
            s = 0
            while s < len(parts):
                e, total = s, 0
                while e < len(parts) and (e == s or total + len(parts[e][2]) <= CHUNK):
                    total += len(parts[e][2])
                    e += 1
                x = np.frombuffer(b"".join(p[2] for p in parts[s:e]), np.uint8)
                lengths = np.fromiter((len(p[2]) for p in parts[s:e]), np.int64, e - s)
                begin = np.cumsum(lengths) - lengths
                valid = np.ones(len(x), bool)
                for end in begin + lengths:
                    valid[end - DEPTH + 1 : end] = False
                key, ctx, q0, p0, count = anchors(x, valid)
                if key_only:
                    yield batch({"key": key}, schema)
                else:
                    part = np.searchsorted(begin, q0, "right") - 1
                    of = np.array([p[0] for p in parts[s:e]])[part]
                    base = np.array([p[1] for p in parts[s:e]]) - begin
                    yield batch({"key": key, "ctx": ctx, "doc": docs[of], "crc": crcs[of], "q0": q0 + base[part], "lead": p0 - q0, "nq": count}, schema)
                s = e

    return rows.mapInArrow(released(run), "key bigint" if key_only else OCC_DDL)


# -- the arrays of one grain

#: Runs [a, b) of a context's windows that another context has too (blobs null), or a piece of a bucket's array.
FOUND = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int64()), *((c, pa.binary()) for c in ("keys", "ctxs", "deals", "counts", "text", "at", "name"))])
FOUND_DDL = "key bigint, ctx bigint, a int, b int, bytes bigint, keys binary, ctxs binary, deals binary, counts binary, text binary, at binary, name binary"
_BLOBS = {"keys": np.int64, "ctxs": np.int64, "deals": np.int32, "counts": np.int32, "text": np.uint8, "at": np.int32, "name": np.int32}


def _runs(hit: np.ndarray, counts: np.ndarray, keys: np.ndarray, ctxs: np.ndarray):
    """Batches of FOUND: the runs of windows marked in hit, context by context."""
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    same = np.concatenate([[False], owner[1:] == owner[:-1]])
    before = np.concatenate([[False], hit[:-1]]) & same
    after = np.concatenate([hit[1:] & same[1:], [False]])
    a, b = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    of = owner[a]
    for s in range(0, len(a), 20_000):
        o = of[s : s + 20_000]
        n = len(o)
        runs = {"key": keys[o], "ctx": ctxs[o], "a": a[s : s + 20_000] - begin[o], "b": b[s : s + 20_000] + 1 - begin[o]}
        yield batch(runs | {c: pa.nulls(n, FOUND.field(c).type) for c in ("bytes", *_BLOBS)}, FOUND)


def _piece(level: Level, keys, ctxs, deals, counts) -> pa.RecordBatch:
    blobs = {"keys": keys, "ctxs": ctxs, "deals": deals, "counts": counts, "text": level.text, "at": level.at, "name": level.name}
    cols = {c: [np.ascontiguousarray(v, _BLOBS[c]).tobytes()] for c, v in blobs.items()}
    return batch({c: [None] for c in ("key", "ctx", "a", "b")} | {"bytes": [len(level.text)]} | cols, FOUND)


class Piece:
    """An array with the contexts it was made of: name n is window n, counted on through the contexts."""

    def __init__(self, blobs: dict[str, bytes]) -> None:
        got = {c: np.frombuffer(blobs[c], kind) for c, kind in _BLOBS.items()}
        self.keys, self.ctxs, self.deals, self.counts = (got[c] for c in ("keys", "ctxs", "deals", "counts"))
        self.level = Level(got["text"], got["at"], got["name"])

    def batch(self) -> pa.RecordBatch:
        return _piece(self.level, self.keys, self.ctxs, self.deals, self.counts)

    def split(self, buckets: int):
        """bucket, piece: the contexts of each bucket with their part of the array, still in order."""
        mine = self.deals.astype(np.int64) & (buckets - 1)
        first = np.cumsum(self.counts) - self.counts
        owner = np.searchsorted(first + self.counts, self.level.name, "right")
        lengths = self.counts.astype(np.int64) + (DEPTH - 1)
        begin = np.cumsum(lengths) - lengths
        for b in np.unique(mine):
            own = mine == b
            if own.all():
                yield int(b), self
                return
            keep = own[owner]
            out = object.__new__(Piece)
            out.keys, out.ctxs, out.deals, out.counts = self.keys[own], self.ctxs[own], self.deals[own], self.counts[own]
            new_first, new_begin = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            new_first[own] = np.cumsum(out.counts) - out.counts
            new_begin[own] = np.cumsum(lengths[own]) - lengths[own]
            o = owner[keep]
            text = np.concatenate([*(self.level.text[s : s + n] for s, n in zip(begin[own], lengths[own], strict=True)), np.zeros(WORD, np.uint8)])
            at = (self.level.at[keep] - begin[o] + new_begin[o]).astype(np.int32)
            out.level = Level(text, at, (self.level.name[keep] - first[o] + new_first[o]).astype(np.int32))
            yield int(b), out

    def join(self, other: Piece, where: np.ndarray, found: np.ndarray) -> Piece:
        out = object.__new__(Piece)
        for c in ("keys", "ctxs", "deals", "counts"):
            setattr(out, c, np.concatenate([getattr(self, c), getattr(other, c)]))
        out.level = merged(self.level, other.level, where, found, int(self.counts.sum()))
        return out


def _buckets(size: int) -> int:
    """A power of two, so that the buckets of one number are divided by those of a larger one."""
    return 1 << max(0, (max(1, -(-size // TASK_BYTES)) - 1).bit_length())


def _arrays(df: DataFrame, buckets: int, keep: bool) -> DataFrame:
    """key, ctx, nq, bytes -> FOUND: in each task a family of suffix arrays over its contexts; with keep also its array."""

    def run(batches):
        family = SuffixFamily(DEPTH)
        cols: dict[str, list] = {c: [] for c in ("key", "ctx", "deal", "nq")}
        strings, begun, held = [], 0, 0

        def feed():
            nonlocal strings, begun, held
            if strings:
                family.add(strings, np.array(cols["nq"][begun:], np.int64))
            strings, begun, held = [], len(cols["nq"]), 0

        for rb in batches:
            got = [rb.column(c).to_pylist() for c in ("key", "ctx", "deal", "nq")]
            for k, c, d, n, raw in zip(*got, rb.column("bytes"), strict=True):
                for col, v in zip(cols.values(), (k, c, d, n), strict=True):
                    col.append(v)
                strings.append(raw.as_py())
                held += n + DEPTH - 1
                if held >= BATCH_BYTES:
                    feed()
        feed()
        if not begun:
            return
        keys, ctxs, deals, counts = (np.array(cols[c], kind) for c, kind in (("key", np.int64), ("ctx", np.int64), ("deal", np.int32), ("nq", np.int64)))
        if keep:
            yield _piece(family.whole(), keys, ctxs, deals, counts)
        yield from _runs(family.matched, counts, keys, ctxs)

    dealt = df.select("key", "ctx", F.hash("key").alias("deal"), "nq", "bytes").repartition(buckets, "key")
    return dealt.mapInArrow(released(run), FOUND_DDL)


def _met(old: DataFrame, new: DataFrame, buckets: int, merge: bool) -> DataFrame:
    """FOUND: pieces of two levels, merge-scanned bucket by bucket; with merge also the pieces of both in one."""
    blobs = list(_BLOBS)
    row = pa.schema([("bucket", pa.int64()), ("fresh", pa.bool_()), *((c, pa.binary()) for c in blobs)])

    def deal(batches):
        for rb in batches:
            for i in range(rb.num_rows):
                piece = Piece({c: rb.column(c)[i].as_py() for c in blobs})
                for b, part in piece.split(buckets):
                    got = part.batch()
                    yield batch({"bucket": [b], "fresh": [rb.column("fresh")[i].as_py()]} | {c: got.column(c) for c in blobs}, row)

    def meet(held: list[Piece], new: list[Piece]):
        for n in new:
            for h in held:
                _, found, there = scan(h.level, n.level, DEPTH)
                for p, hit in ((n, found), (h, there)):
                    marks = np.zeros(int(p.counts.sum()), bool)
                    marks[p.level.name[hit]] = True
                    yield from _runs(marks, p.counts.astype(np.int64), p.keys, p.ctxs)
        if merge and held + new:
            out = (held + new)[0]
            for p in (held + new)[1:]:
                where, found, _ = scan(out.level, p.level, DEPTH)
                out = out.join(p, where, found)
            yield out.batch()

    def run(batches):
        at, held, new = None, [], []
        for rb in batches:
            for i in range(rb.num_rows):
                b = rb.column("bucket")[i].as_py()
                if b != at:
                    yield from meet(held, new)
                    at, held, new = b, [], []
                (new if rb.column("fresh")[i].as_py() else held).append(Piece({c: rb.column(c)[i].as_py() for c in blobs}))
        yield from meet(held, new)

    ddl = "bucket bigint, fresh boolean, " + ", ".join(f"{c} binary" for c in blobs)
    both = old.select(F.lit(False).alias("fresh"), *blobs).unionByName(new.select(F.lit(True).alias("fresh"), *blobs))
    dealt = both.mapInArrow(released(deal), ddl).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(released(run), FOUND_DDL)


PARTS = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("base", pa.int32()), ("skey", pa.int64()), ("sctx", pa.int64()), ("lead", pa.int16()), ("nq", pa.int16()), ("bytes", pa.binary())])


def _narrower(df: DataFrame, step: int) -> DataFrame:
    """Cut contexts into those of ``step`` neighbouring places of a window against the anchor, dealt by the bytes that
    all windows there share."""

    def run(batches):
        for rb in batches:
            cols: dict[str, list] = {f.name: [] for f in PARTS}
            for key, ctx, lead, nq, raw in zip(*(rb.column(c).to_pylist() for c in ("key", "ctx", "lead", "nq", "bytes")), strict=True):
                a = 0
                while a < nq:
                    g = (a - lead) // step  # place against the anchor
                    b = min(nq, g * step + step + lead)
                    core = raw[g * step + step - 1 + lead : g * step + DEPTH + lead]
                    sub = raw[a : b + DEPTH - 1]
                    skey = hashlib.blake2b(core, digest_size=8, salt=(g & 0xFFFF).to_bytes(2, "little")).digest()
                    sctx = hashlib.blake2b(sub, digest_size=8, person=b"context").digest()
                    for c, v in zip(cols, (key, ctx, a, int.from_bytes(skey, "little", signed=True), int.from_bytes(sctx, "little", signed=True), lead - a, b - a, sub), strict=True):
                        cols[c].append(v)
                    a = b
                if len(cols["key"]) > 5000:
                    yield batch(cols, PARTS)
                    cols = {f.name: [] for f in PARTS}
            yield batch(cols, PARTS)

    return df.select("key", "ctx", "lead", "nq", "bytes").mapInArrow(run, "key bigint, ctx bigint, base int, skey bigint, sctx bigint, lead smallint, nq smallint, bytes binary")


# -- the index


class SuffixIndex:
    """Repeated passages of documents that come in batches. With ``keep`` the index stays in the shared folder under
    ``path``; ``SuffixIndex(spark, path)`` opens it again. Without, it takes one batch, and ``finish`` deletes what it wrote."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: bool = True) -> None:
        tune(spark)
        self.spark, self.keep = spark, keep
        self.path = path or new_path(spark, "suffix-index")
        self.tables: dict[str, list[str]] = {}  # what is kept, by kind
        self.levels: dict[str, list[dict]] = {}  # by grain, the largest first
        self.adds, self._written = 0, []
        if path is not None and keep:
            last = self._state().orderBy(F.desc("adds")).first()
            self.adds, self.tables, self.levels = last["adds"], json.loads(last["tables"]), json.loads(last["levels"])

    def _state(self) -> DataFrame:
        return self.spark.read.schema("adds bigint, tables string, levels string").json(f"{self.path}/state/*")

    def _stored(self, kind: str) -> DataFrame | None:
        out = None
        for path in self.tables.get(kind, ()):
            part = self.spark.read.parquet(path)
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, df: DataFrame, kind: str, part_of_index: bool = False) -> DataFrame:
        """Written and read again; part_of_index: kept with the index, else deleted by finish()."""
        if part_of_index and self.keep:
            out = materialise(df, path=f"{self.path}/{kind}-{uuid.uuid4().hex}")
            self.tables[kind] = [*self.tables.get(kind, ()), out._stored_at]
            return out
        out = materialise(df, kind)
        self._written.append(out)
        return out

    def finish(self) -> None:
        """Delete the tables that nothing needs once the results have been written."""
        discard(*self._written)
        self._written = []

    def _with_old(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        new = new.withColumn("old", F.lit(False))
        return new if old is None else new.unionByName(old.withColumn("old", F.lit(True)))

    def _grain(self, g: int, new: DataFrame, old: DataFrame | None, texts_of) -> DataFrame:
        """new, old: contexts (key, ctx, n, lead, nq, one, two). texts_of fetches the bytes of some of them. Returns key, ctx, a, b."""
        both = self._with_old(new, old)
        was = F.col("old").cast("int")
        stats = both.groupBy("key").agg(F.sum("n").alias("total"), F.sum(F.col("n") * was).alias("before"), F.count("*").alias("kinds"), F.sum(was).alias("kinds_before"))
        # anchors that occur again and have something new; written apart, so that the join's sides are plain shuffles
        live = self._write(stats.where("total > 1 and kinds > kinds_before"), f"live{g}")
        # older contexts come along if their anchor had no company before, or is dealt more finely from now on
        turned = F.lit(False) if g == len(CELLS) else (F.col("kinds") > MOST_CONTEXTS) & (F.col("kinds_before") <= MOST_CONTEXTS)
        go = both.join(live, "key").where(~F.col("old") | (F.col("before") == 1) | turned)
        texts = self._write(texts_of(go.select("key", "ctx", "n", "lead", "nq", "one", "two", "kinds")), f"texts{g}")
        if g == len(CELLS):
            return self._family(g, texts)
        found = self._family(g, texts.where(F.col("kinds") <= MOST_CONTEXTS))
        if live.where(F.col("kinds") > MOST_CONTEXTS).isEmpty():
            return found
        parts = self._write(_narrower(texts.where(F.col("kinds") > MOST_CONTEXTS), CELLS[g]), f"parts{g}", True)
        once = parts.groupBy(F.col("skey").alias("key"), F.col("sctx").alias("ctx")).agg(
            F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("nq").alias("nq"), F.min("bytes").alias("one"), F.max("bytes").alias("two")
        )
        before = self._stored(f"contexts{g + 1}")
        once = self._write(once, f"contexts{g + 1}", True)
        finer = self._grain(g + 1, once, before, _own_texts).select(F.col("key").alias("skey"), F.col("ctx").alias("sctx"), "a", "b")
        every = self._stored(f"parts{g}") if self.keep else parts
        back = every.select("key", "ctx", "base", "skey", "sctx").distinct().join(finer, ["skey", "sctx"])
        return found.unionByName(back.select("key", "ctx", (F.col("base") + F.col("a")).alias("a"), (F.col("base") + F.col("b")).alias("b")))

    def _family(self, g: int, texts: DataFrame) -> DataFrame:
        """Suffix arrays over the contexts, met with the levels of the grain. Returns key, ctx, a, b."""
        size = texts.agg(F.sum(F.length("bytes")).alias("n")).first()["n"] or 0
        buckets = _buckets(size)
        got = _arrays(texts, buckets, self.keep)
        if not self.keep:  # read once, by repeats()
            return got.select("key", "ctx", "a", "b")
        got = self._write(got, f"arrays{g}")
        found, levels = got.where("bytes is null"), self.levels.get(str(g), [])
        if not size:
            return found.select("key", "ctx", "a", "b")
        new = got.where("bytes is not null")
        for k in range(len(levels) - 1, -1, -1):
            level = levels[k]
            merge = level["size"] <= 2 * size
            if merge:
                size += level["size"]
                del levels[k]
            buckets = max(buckets, level["buckets"], _buckets(size))
            got = self._write(_met(self.spark.read.parquet(level["path"]), new, buckets, merge), f"met{g}")
            found = found.unionByName(got.where("bytes is null"))
            if merge:
                new = got.where("bytes is not null")
        out = materialise(new, path=f"{self.path}/level{g}-{uuid.uuid4().hex}")
        levels.append({"path": out._stored_at, "size": int(size), "buckets": buckets})
        self.levels[str(g)] = levels
        return found.select("key", "ctx", "a", "b")

    def _fetched(self, go: DataFrame) -> DataFrame:
        """The bytes of up to two places of each context, each from its document."""
        place = F.when(F.col("n") > 1, F.array("one", "two")).otherwise(F.array("one"))
        wanted = go.select("key", "ctx", "kinds", "lead", "nq", F.explode(place).alias("at")).select("key", "ctx", "kinds", "lead", "nq", "at.doc", "at.crc", "at.q0")
        # a document's contexts are at most as many as its bytes, whatever the size of the table
        wanted = wanted.groupBy("doc", "crc").agg(F.collect_list(F.struct("key", "ctx", "kinds", "q0", "lead", "nq")).alias("want"))
        once = self._docs.groupBy("doc", "crc").agg(F.first("raw").alias("raw"))  # rows that are repeated give their text once
        schema = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("kinds", pa.int64()), ("lead", pa.int16()), ("nq", pa.int16()), ("bytes", pa.binary())])

        def run(batches):
            for rb in batches:
                cols: dict[str, list] = {f.name: [] for f in schema}
                held = 0
                for raw, want in zip(rb.column("raw"), rb.column("want"), strict=True):
                    raw = raw.as_py()
                    for w in want.as_py():
                        for c in ("key", "ctx", "kinds", "lead", "nq"):
                            cols[c].append(w[c])
                        cols["bytes"].append(raw[w["q0"] : w["q0"] + w["nq"] + DEPTH - 1])
                        held += DEPTH + w["nq"]
                        if held > 1_000_000:
                            yield batch(cols, schema)
                            cols, held = {f.name: [] for f in schema}, 0
                yield batch(cols, schema)

        return once.join(wanted, ["doc", "crc"]).select("raw", "want").mapInArrow(released(run), "key bigint, ctx bigint, kinds bigint, lead smallint, nq smallint, bytes binary")

    def add(self, docs: DataFrame) -> None:
        """Take in a batch of documents (doc_id, text)."""
        rows = dealt(_rows(docs))
        if self.keep:
            rows = self._write(rows, "docs", True)
            occ = self._write(_occurrences(rows, False), "occurrences", True)
            self._docs = self._stored("docs")
        else:
            if self.adds:
                raise ValueError("an index that is not kept takes one batch")
            # anchors that occur once are left out before anything else is worked out or written
            self._docs = rows
            again = self._write(_occurrences(rows, True).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
            occ = self._write(_occurrences(rows, False).join(again, "key", "left_semi"), "occurrences")
            self._occ = occ
        place = F.struct("doc", "crc", "q0")
        contexts = occ.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("nq").alias("nq"), F.min(place).alias("one"), F.max(place).alias("two"))
        before = self._stored("contexts0")
        found = self._grain(0, self._write(contexts, "contexts0", True), before, self._fetched)
        # what is not kept goes on to repeats() without a table: executors start a process for each file they create on local disks
        self._found = self._write(found, "found", True) if self.keep else found
        self.adds += 1
        if self.keep:
            state = self.spark.createDataFrame([(self.adds, json.dumps(self.tables), json.dumps(self.levels))], "adds bigint, tables string, levels string")
            state.coalesce(1).write.json(f"{self.path}/state/{self.adds}")

    def repeats(self) -> DataFrame:
        """doc, crc, found: for each row with repeated windows, the byte ranges that they cover (may overlap)."""
        occ, found = (self._stored("occurrences"), self._stored("found")) if self.keep else (self._occ, self._found)
        covered = occ.join(found.distinct(), ["key", "ctx"])
        ranges = covered.select("doc", "crc", (F.col("q0") + F.col("a")).alias("a"), (F.col("q0") + F.col("b") + (DEPTH - 1)).alias("b"))
        # rows that repeat an id and its text have one set of ranges
        return ranges.distinct().groupBy("doc", "crc").agg(F.collect_list(F.struct("a", "b")).alias("found"))


def _own_texts(go: DataFrame) -> DataFrame:
    texts = F.when(F.col("n") > 1, F.array("one", "two")).otherwise(F.array("one"))
    return go.select("key", "ctx", "kinds", "lead", "nq", F.explode(texts).alias("bytes"))


def repeats(docs: DataFrame) -> DataFrame:
    """The ranges of an index of this one batch, written; ``finish`` of what it returns deletes them."""
    index = SuffixIndex(docs.sparkSession, keep=False)
    index.add(docs)
    out = materialise(index.repeats(), "repeats")
    index.finish()
    return out


def union_of(found: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted disjoint ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((f["a"], f["b"]) for f in found or ()):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    if not removed:
        return raw
    return b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in removed)], [*(r[0] for r in removed), len(raw)], strict=True))


def _with_repeats(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found = repeats(docs)
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_crc": _digest(text)}).join(
        found.select(F.col("doc").alias("_doc"), F.col("crc").alias("_crc"), F.col("found").alias("_found")), ["_doc", "_crc"], "left"
    )


SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs."""
    joined = _with_repeats(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_found")

    def run(batches):
        for rb in batches:
            cols: dict[str, list] = {f.name: [] for f in SPANS}
            for doc, text, found in zip(*(rb.column(c).to_pylist() for c in ("doc_id", "text", "_found")), strict=True):
                raw, removed = (text or "").encode("utf-8"), union_of(found)
                row = (doc, len(raw), sum(b - a for a, b in removed), len(removed), hashlib.sha256(kept(raw, removed)).hexdigest())
                for c, v in zip(cols, row, strict=True):
                    cols[c].append(v)
            yield batch(cols, SPANS)

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of ``text``, in docs' own columns. A character of which a removed range
    covers a part goes as a whole; a null text stays null."""
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    joined = _with_repeats(docs).select(*names, "_found")

    def run(batches):
        for rb in batches:
            texts = [
                t if t is None or f is None else kept(t.encode("utf-8"), union_of(f)).decode("utf-8", "ignore")
                for t, f in zip(rb.column(at).to_pylist(), rb.column(len(names)).to_pylist(), strict=True)
            ]
            rb = rb.select(names) if len(set(rb.schema.names)) == len(rb.schema.names) else rb
            yield rb.set_column(at, rb.schema.field(at), pa.array(texts, rb.schema.field(at).type))

    return joined.mapInArrow(run, schema)
