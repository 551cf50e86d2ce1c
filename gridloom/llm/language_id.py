"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of orders 3 down to 0, with the counts frozen after training. A
byte's code length follows the escape chain: a context codes a byte it has seen with its share of the
count, or escapes with the share of its distinct bytes; bytes that a longer context has already ruled out are
excluded from the shorter ones; below order 0 all bytes not yet ruled out are equally likely. A text belongs
to the language whose tree gives it the fewest bits, and the score is that language's posterior probability
under equal priors.

Training takes at most ``MAX_TRAINING_ROWS`` labelled rows of each language, those with the least hashes of id and
text, with their whole texts. As the bytes a longer context has seen are always a part of those that a shorter one
has, what is excluded can be summed once for each context, and a byte with its three predecessors has one
fixed price in every language: prices of all four-byte strings seen in training are tabled, others are
worked out when met.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing
was learned; ties go to the language first by name; repeated rows get equal results; texts of any length are priced
whole; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, concat_utf8, dealt, texts_of, tune

ORDER = 3
MAX_TRAINING_ROWS = 3000
UNKNOWN = "und"
BLOCK_CHARS = 1 << 20
#: Four-byte strings are looked up in a square table of the byte pairs seen, up to this many pairs.
MOST_PAIRS = 6000

_LETTER = re.compile(r"[^\W\d_]")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte string that ends at each byte of the texts, three zero bytes standing before each text, and the texts' lengths."""
    x, starts, lengths = concat_utf8(texts, ORDER)
    x = x.astype(np.uint32)
    code = x[3:] | x[2:-1] << np.uint32(8) | x[1:-2] << np.uint32(16) | x[:-3] << np.uint32(24)
    keep = np.ones(len(code), bool)
    for end in starts + lengths:
        keep[end - 3 : end] = False
    return code[keep], lengths


@dataclass
class Tree:
    """The contexts of one language. For each order k: known[k], count[k] of contexts with their next byte, and of the
    contexts themselves: context[k], total[k], distinct[k], and excluded[k], what order k+1 takes away, found by the
    longer context."""

    codes: np.ndarray
    counts: np.ndarray
    known: list[np.ndarray] = field(init=False)
    count: list[np.ndarray] = field(init=False)
    context: list[np.ndarray] = field(init=False)
    total: list[np.ndarray] = field(init=False)
    distinct: list[np.ndarray] = field(init=False)
    excluded: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.known, self.count, self.context, self.total, self.distinct, self.excluded = [], [], [], [], [], []
        codes = self.codes.astype(np.int64)
        for k in range(ORDER + 1):
            own, at = np.unique(codes & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, weights=self.counts, minlength=len(own))
            ctx, of = np.unique(own >> 8, return_inverse=True)
            self.known.append(own)
            self.count.append(n)
            self.context.append(ctx)
            self.total.append(np.bincount(of, weights=n, minlength=len(ctx)))
            self.distinct.append(np.bincount(of, minlength=len(ctx)).astype(float))
        for k in range(ORDER):
            # counts at order k of the bytes seen after each longer context of order k + 1
            longer = self.known[k + 1]
            at = np.searchsorted(self.known[k], longer & ((1 << 8 * (k + 1)) - 1))
            of = np.searchsorted(self.context[k + 1], longer >> 8)
            self.excluded.append(np.bincount(of, weights=self.count[k][at], minlength=len(self.context[k + 1])))

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_, x), max(len(sorted_) - 1, 0))
        return at, sorted_[at] == x if len(sorted_) else np.zeros(len(x), bool)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte string after the other three."""
        codes = codes.astype(np.int64)
        cost, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        gone_total, gone_distinct = np.zeros(len(codes)), np.zeros(len(codes))  # what longer contexts exclude here
        for k in range(ORDER, -1, -1):
            own = codes & ((1 << 8 * (k + 1)) - 1)
            c, have = self._find(self.context[k], own >> 8)
            s, seen = self._find(self.known[k], own)
            n = np.where(have, self.total[k][c] - gone_total, 0.0)
            d = np.where(have, self.distinct[k][c] - gone_distinct, 0.0)
            whole = n + d
            hit = open_ & seen
            cost[hit] -= np.log2(self.count[k][s[hit]] / whole[hit])
            open_ &= ~seen
            out = open_ & have & (whole > 0)
            cost[out] -= np.log2(d[out] / whole[out])
            gone_distinct = np.where(have, self.distinct[k][c], gone_distinct)
            if k:
                gone_total = np.where(have, self.excluded[k - 1][c], 0.0)
                gone_distinct = np.where(have, self.distinct[k][c], 0.0)
        cost[open_] += np.log2(np.maximum(256 - gone_distinct[open_], 1.0))
        return cost


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    _table: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def _tabled(self) -> tuple:
        """Prices of the four-byte strings seen, and where to find them by the two pairs of bytes."""
        if self._table is None:
            codes = np.unique(np.concatenate([t.codes for t in self.trees])).astype(np.int64)
            pairs = np.unique(np.concatenate([codes >> 16, codes & 0xFFFF]))
            prices = np.stack([t.bits(codes) for t in self.trees], 1)
            square = None
            number = np.zeros(1 << 16, np.int32)
            if len(pairs) <= MOST_PAIRS:
                number[pairs] = np.arange(1, len(pairs) + 1)
                square = np.full((len(pairs) + 1) ** 2, -1, np.int32)
                square[number[codes >> 16] * (len(pairs) + 1) + number[codes & 0xFFFF]] = np.arange(len(codes))
            self._table = codes, prices, number, square, len(pairs) + 1
        return self._table

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language."""
        code, lengths = _codes(texts)
        codes, prices, number, square, side = self._tabled()
        if square is not None:
            at = square[number[code >> np.uint32(16)] * np.int32(side) + number[code & np.uint32(0xFFFF)]]
        else:
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            at = np.where(codes[at] == code, at, -1)
        price = prices[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, back = np.unique(code[new], return_inverse=True)
            price[new] = np.stack([t.bits(fresh) for t in self.trees], 1)[back]
        out = np.zeros((len(texts), len(self.langs)))
        some = lengths > 0
        if some.any():
            begin = (np.cumsum(lengths) - lengths)[some]
            out[some] = np.add.reduceat(price, begin, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        real = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.langs or not real:
            return langs, scores
        start = total = 0
        for k, i in enumerate(real):
            total += len(texts[i])
            if total >= BLOCK_CHARS or k == len(real) - 1:
                own = real[start : k + 1]
                bits = self.bits([texts[i] for i in own])
                best = bits.argmin(axis=1)
                gap = bits - bits.min(axis=1, keepdims=True)
                share = 1 / np.exp2(-np.minimum(gap, 1000.0)).sum(axis=1)
                for j, i in enumerate(own):
                    langs[i], scores[i] = self.langs[best[j]], share[j]
                start, total = k + 1, 0
        return langs, scores


def drawn(rows: DataFrame, max_rows: int) -> DataFrame:
    """text, lang of the ``max_rows`` rows of each language with the least hashes of id and text, of all rows where there
    are fewer; rows that repeat both count once."""
    h = F.xxhash64("id", "text")
    hashed = rows.withColumn("h", h)
    # about twice as many as wanted, so that a language of any size sends a bounded number of hashes to be ranked
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    names = {r["lang"]: r["n"] for r in sizes.collect()}  # languages are few: their names go back, however many rows they have
    if not names:
        return rows.select("text", "lang")
    table = lambda of: F.create_map(*(x for k in sorted(names) for x in (F.lit(k), F.lit(of[k]))))
    few = hashed.where(F.col("h") <= table({k: bound_of(n, max_rows) for k, n in names.items()})[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = few.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= max_rows).groupBy("lang").agg(F.max("h").alias("last"))
    bounds = {r["lang"]: r["last"] for r in last.collect()}
    bounds |= {k: -(1 << 63) for k in names if k not in bounds}
    return hashed.where(F.col("h") <= table(bounds)[F.col("lang")]).dropDuplicates(["lang", "h"]).select("text", "lang")


def bound_of(n: int, max_rows: int) -> int:
    """The hash below which about twice ``max_rows`` of n distinct hashes lie, the greatest where there are no more."""
    return (1 << 63) - 1 if n <= 2 * max_rows else -(1 << 63) + (1 << 64) * 2 * max_rows // n


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """labelled: id, text, lang; rows whose lang is null are no training rows."""
    tune(labelled.sparkSession)
    sample = drawn(labelled.where(F.col("lang").isNotNull()).select("id", "text", "lang"), max_rows)
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for rb in batches:
            texts, langs = np.array(texts_of(rb.column("text")), object), np.array(rb.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                own = [t for t in texts[langs == lang] if t]
                if own:
                    codes, n = np.unique(_codes(own)[0], return_counts=True)
                    yield batch({"lang": [lang] * len(codes), "code": codes.astype(np.int64), "n": n}, schema)

    got = sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    if got.empty:
        return Model([], [])
    trees = {lang: Tree(part["code"].to_numpy(np.int64), part["n"].to_numpy(float)) for lang, part in got.groupby("lang")}
    langs = sorted(trees)
    return Model(langs, [trees[lang] for lang in langs])


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of docs."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rb in batches:
            langs, scores = shared.value.predict(rb.column("text").to_pylist())
            yield batch({"doc_id": rb.column("id"), "lang_pred": langs, "score": scores}, PREDICTED)

    return dealt(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
