"""Packing by non-negative least squares on the length histogram.

Documents become token ids and one closing id 0; documents longer than the window are cut into full
windows and a rest. Only the histogram of the pieces' lengths, at most ``window`` numbers, reaches the
driver. There all combinations of at most three lengths that fill the window exactly are listed, their
repeat counts are solved by non-negative least squares against the histogram and rounded down to what the
histogram still holds, and what is left is packed greedily, largest length first. The outcome is a plan:
for each length, consecutive ranks belong to consecutive sequences of one combination. Each piece's rank
among the pieces of its length is counted on the executors in buckets of a hash of the id, so neither a
length nor an id that many rows share meets in one task.

Defined results: null and empty texts are one piece, the closing id; repeated rows are packed each; a very long text is
cut into as many pieces as it takes; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, dealt, materialise, released, texts_of, tune

WINDOW = 1024
#: Texts within these code points are split and merged alike by both tokenizer libraries; others go
#: through the slower one that defines the ids.
PLAIN = 0x17F


@cache
def _tokenizers(json_path: str, ranks_path: str | None, pattern: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return exact, None
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return exact, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Tokenization:
    """json_path defines the ids; ranks_path, if given, holds the same vocabulary for a faster library that
    is used where both agree by construction: on texts of Latin characters without special tokens."""

    json_path: str
    ranks_path: str | None = None
    pattern: str = ""

    def ids(self, text: str) -> list[int]:
        exact, fast = _tokenizers(self.json_path, self.ranks_path, self.pattern)
        if fast is None or "<|" in text or (not text.isascii() and max(text) > chr(PLAIN)):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)


def public_tokenization() -> Tokenization:
    import public_tokenizers as P

    return Tokenization(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokens: Tokenization, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    tune(docs.sparkSession)

    def run(batches):
        for rb in batches:
            ids_in, cols = rb.column("id").to_pylist(), {f.name: [] for f in PIECES}
            for doc, text in zip(ids_in, texts_of(rb.column("text")), strict=True):
                ids = np.array([*tokens.ids(text), 0], "<u4")
                for a in range(0, len(ids), window):
                    piece = ids[a : a + window]
                    for k, v in zip(cols, (doc, a, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        cols[k].append(v)
            yield batch(cols, PIECES)

    return dealt(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(released(run), PIECES_DDL)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All multisets of one to three of the lengths whose sum is the window; rows of three, zeros first."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    ls = np.flatnonzero(have)
    rows = [np.array([[0, 0, window]])] if have[window] else []
    rest = window - ls
    two = ls[(rest >= ls) & have[np.clip(rest, 0, window)]]
    rows.append(np.stack([np.zeros_like(two), two, window - two], 1))
    a, b = np.meshgrid(ls, ls, indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c) & have[np.clip(c, 0, window)]
    rows.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(rows)


def nnls(combos: np.ndarray, hist: np.ndarray, steps: int = 600) -> np.ndarray:
    """x >= 0 that nearly minimises the squared distance of the combinations' use of each length to the
    histogram, each length weighted by the inverse root of its count, by accelerated projected gradient."""
    m = len(hist)
    weight = 1 / np.sqrt(np.maximum(hist, 1.0))
    weight[0] = 0.0
    use = lambda x: sum(np.bincount(combos[:, k], weights=x, minlength=m) for k in range(3))
    back = lambda v: sum(v[combos[:, k]] for k in range(3))
    # a scale for each combination makes the problem about as steep in every direction
    degree = np.maximum(use(np.ones(len(combos))), 1.0)
    scale = 1 / np.maximum(back(weight**2 * degree), 1e-12)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        grad = back(weight**2 * (use(y) - hist))
        nx = np.maximum(0.0, y - scale * grad)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nx + (t - 1) / nt * (nx - x), nx, nt
    return x


def solve(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): combinations that use up hist exactly. hist[l]: pieces of length l, l <= window."""
    left = hist.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        for l in lengths:
            left[l] -= times
        plan.append((lengths, times))

    if left[window]:
        take((window,), int(left[window]))
    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        x = nnls(combos, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            n = int(round(x[i]))
            if n < 1:
                break
            lengths = tuple(int(l) for l in combos[i] if l)
            n = min([n, *(int(left[l]) // lengths.count(l) for l in set(lengths))])
            if n > 0:
                take(lengths, n)
    while left.any():
        have = np.flatnonzero(left)
        room, lengths, used = window, [], {}
        while room:
            at = int(np.searchsorted(have, room, "right")) - 1
            while at >= 0 and left[have[at]] <= used.get(int(have[at]), 0):
                at -= 1
            if at < 0:
                break
            l = int(have[at])
            lengths.append(l)
            used[l] = used.get(l, 0) + 1
            room -= l
        take(tuple(lengths), min(int(left[l]) // n for l, n in used.items()))
    return plan


@dataclass
class Slots:
    """Where the rank-th piece of a length goes. Rows are ordered by (length, first)."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    length: np.ndarray

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (lengths.astype(np.uint64) << np.uint64(48)) | ranks.astype(np.uint64), "right") - 1
        inside = ranks - self.first[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * self.length[at]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> Slots:
    rows, taken, sequence = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for l in dict.fromkeys(lengths):
            n = lengths.count(l)
            rows.append((l, taken.get(l, 0), sequence, n, offset))
            taken[l] = taken.get(l, 0) + n * times
            offset += n * l
        sequence += times
    rows.sort()
    length, first, seq, each, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
    return Slots((length.astype(np.uint64) << np.uint64(48)) | first.astype(np.uint64), first, seq, each, offset, length)


PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED_DDL = PIECES_DDL + ", sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokens: Tokenization, window: int = WINDOW, rows_per_bucket: int = 10_000, **columns: str) -> DataFrame:
    """One row for each piece: where it stands in its document and in its sequence."""
    cut = materialise(pieces(docs, tokens, window, **columns), "pieces")
    by_length = cut.groupBy("length").agg(F.count("*").alias("n"))
    hist = np.zeros(window + 1, np.int64)
    for r in by_length.collect():  # at most ``window`` rows
        hist[r["length"]] = r["n"]
    plan = docs.sparkSession.sparkContext.broadcast(slots(solve(hist, window)))  # at most a few numbers for each of the plan's combinations
    n_buckets = max(1, int(hist.sum()) // rows_per_bucket)
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = bucketed.withColumn("rn", F.row_number().over(within) - 1).join(counts, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("rn"))

    def place(batches):
        for rb in batches:
            s, o = plan.value.place(np.asarray(rb.column("length")), np.asarray(rb.column("rank")))
            yield batch({n: rb.column(n) for n in PIECES.names} | {"sequence_id": s, "offset": o}, PACKED)

    return ranked.select(*PIECES.names, "rank").mapInArrow(place, PACKED_DDL)
