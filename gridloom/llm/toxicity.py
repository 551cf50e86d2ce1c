"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a sample of at most ``MAX_TRAINING_ROWS`` labelled rows, chosen by a hash of the id. The
class counts of every n-gram, named by a 63-bit hash, are taken on the executors. The ratios ``r`` come from
those counts; the n-grams that separate the classes best are kept, of those that speak for the class and of
those that speak against it, and a logistic regression is fitted on ``r * share``. A text is divided into equal
segments of about ``SEGMENT`` characters; share is the part of them that hold the n-gram. So a score is the mean
over the whole text, whatever its length. Scoring covers every row and every character.

Defined results: null and empty texts hold no n-gram and get the score of the intercept; with no
labelled row at all every score is 0; with one class only, the score is that class's smoothed share.
Repeated rows are scored alike; of labelled rows, those that repeat id, text and label count once, and different labels
of an id count each; equally telling n-grams are kept by name. Texts of any length are scored whole; an empty table gives no
rows; extra columns, whatever their names, are ignored by ``score`` and passed through by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, dealt, discard, materialise, released, texts_of, tune

ORDERS = (5, 6, 7)
#: Bits of an n-gram's name, and how many of them say at once that most n-grams are no feature.
BITS, SIEVE_BITS = 63, 20
PAD = max(ORDERS)
BLOCK_CHARS = 1 << 20
#: A task hands on its n-grams' counts once it holds more than this many.
HELD_GRAMS = 4_000_000
#: Characters of a segment. A text of less than one and a half is one segment.
SEGMENT = 2000
#: The classifier learns from at most this many labelled rows.
MAX_TRAINING_ROWS = 20_000


@dataclass
class Model:
    """features: names of n-grams, ascending; weight: of each; bias: intercept; sieve: which leading bits features have."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    constant: float | None = None
    _sieve: np.ndarray | None = None

    @property
    def sieve(self) -> np.ndarray:
        if self._sieve is None:
            self._sieve = np.zeros(1 << SIEVE_BITS, bool)
            self._sieve[self.features >> (BITS - SIEVE_BITS)] = True
        return self._sieve

    def __getstate__(self):
        return self.__dict__ | {"_sieve": None}


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with PAD zeros between them, each text's first position and number of
    positions; n-grams that start in the zeros before a text are its own."""
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    gap = bytes(4 * PAD)
    joined = np.frombuffer(gap + gap.join(raw) + gap, np.uint32)
    sizes = np.fromiter((len(r) // 4 + PAD for r in raw), np.int64, len(raw))
    return joined, np.cumsum(sizes) - sizes, sizes


def _grams(codes: np.ndarray, a: int, b: int):
    """For each order, the names of the n-grams that start at the positions from a to b."""
    c = codes[a : b + PAD].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = b - a
    h = np.full(n, 0x243F6A8885A308D3, np.uint64)
    for k in range(PAD):
        h ^= c[k : k + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        if k + 1 in ORDERS:
            g = (h ^ np.uint64(k + 1)) * np.uint64(0x94D049BB133111EB)
            g ^= g >> np.uint64(32)
            yield (g >> np.uint64(64 - BITS)).view(np.int64)


def _distinct(codes: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(0, np.int64)
    for s in range(a, b, BLOCK_CHARS):
        out = np.unique(np.concatenate([out, *_grams(codes, s, min(b, s + BLOCK_CHARS))]))
    return out


def present(texts: list[str], model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, as two arrays; without model every n-gram is a feature, by its name."""
    if model is not None:
        return shares(texts, model)[:2]
    codes, starts, sizes = _codes(texts)
    found = [_distinct(codes, a, a + n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int64), *found])


def shares(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, and in which share of the text's segments the feature occurs."""
    codes, starts, sizes = _codes(texts)
    m, places, feats = len(model.features), [], []
    for a in range(0, int(sizes.sum()) if m else 0, BLOCK_CHARS):
        for g in _grams(codes, a, min(len(codes) - PAD, a + BLOCK_CHARS)):
            at = np.flatnonzero(model.sieve[g >> (BITS - SIEVE_BITS)])
            f = np.minimum(np.searchsorted(model.features, g[at]), m - 1)
            same = model.features[f] == g[at]
            places.append(at[same] + a)
            feats.append(f[same])
    none = np.zeros(0, np.int64)
    place, feat = np.concatenate([none, *places]), np.concatenate([none, *feats])
    segments = np.maximum(1, (sizes - PAD + SEGMENT // 2) // SEGMENT)
    first = np.cumsum(segments) - segments
    owner = np.searchsorted(starts, place, "right") - 1
    segment = first[owner] + (place - starts[owner]) * segments[owner] // sizes[owner]
    held = np.unique(segment * m + feat)
    owner = np.searchsorted(first, held // max(m, 1), "right") - 1
    pairs, n = np.unique(owner * m + held % max(m, 1), return_counts=True)
    owner = pairs // max(m, 1)
    return owner, pairs % max(m, 1), n / segments[owner]


def _text_blocks(texts: list[str]):
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= BLOCK_CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    out = np.empty(len(texts))
    for a, b in _text_blocks(texts):
        owner, feat, share = shares(texts[a:b], model)
        z = model.bias + np.bincount(owner, weights=model.weight[feat] * share, minlength=b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and the sums of their counts."""
    gram, n = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(gram)
    gram, n = gram[order], n[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]]))
    return gram[at], np.add.reduceat(n, at) if len(at) else n


def _fit(rows: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, r: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on r * share by accelerated gradient steps."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    idx = np.concatenate(rows).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    x = r[idx] * np.concatenate(shares) if len(rows) else np.zeros(0)
    n, m = len(rows), len(r)
    norm = np.bincount(owner, weights=x * x, minlength=n)
    rate = 4.0 / (norm.mean() + norm.max() * 0.1 + 1.0)
    w, b = np.ones(m) * 0.05, float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    vw, vb, pw, pb, t = w.copy(), b, w.copy(), b, 1.0
    for _ in range(steps):
        z = vb + np.bincount(owner, weights=x * vw[idx], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        gw = np.bincount(idx, weights=x * g[owner], minlength=m) + l2 * (vw - 0.05)
        w, b = vw - rate * gw, vb - rate * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = w + (t - 1) / nt * (w - pw), b + (t - 1) / nt * (b - pb)
        pw, pb, t = w, b, nt
    return w, b


def bounded(labelled: DataFrame, max_rows: int) -> DataFrame:
    """id, text, label: of the rows with a label the max_rows with the least hashes; rows that repeat all three count once."""
    rows = labelled.where(F.col("label").isin(0, 1)).select("id", "text", F.col("label").cast("int").alias("label"))
    hashed = rows.withColumn("h", F.xxhash64("id", "text", "label"))
    last = hashed.select("h").distinct().orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    return hashed.where(F.lit(False) if last is None else F.col("h") <= last).dropDuplicates(["h"]).drop("h")


def train(
    labelled: DataFrame, max_features: int = 2048, max_against: int = 256, l2: float = 1e-3, steps: int = 600, alpha: float = 1.0, max_rows: int = MAX_TRAINING_ROWS
) -> Model:
    """labelled: id, text, label (0 or 1; other labels and null count as no label), of which at most max_rows are learned
    from. max_features: n-grams that speak for label 1; max_against: n-grams that speak against it, which are common
    ones and so more to fit on."""
    tune(labelled.sparkSession)
    rows = materialise(bounded(labelled, max_rows), "sample")
    try:
        return _trained(dealt(rows), max_features, max_against, l2, steps, alpha)
    finally:
        discard(rows)


def _trained(rows: DataFrame, max_features: int, max_against: int, l2: float, steps: int, alpha: float) -> Model:
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return Model(constant=0.0)
    if len(sizes) < 2:
        return Model(constant=(sizes.get(1, 0) + 1.0) / (total + 2.0))
    schema = pa.schema([("gram", pa.int64()), ("neg", pa.int64()), ("pos", pa.int64())])

    def count(batches):
        def out(gram, n):  # n: rows of label 0, and 2**32 times those of label 1
            for s in range(0, len(gram), 50_000):
                part = n[s : s + 50_000]
                yield batch({"gram": gram[s : s + 50_000], "neg": part & 0xFFFFFFFF, "pos": part >> 32}, schema)

        held, fresh = [], 0
        for rb in batches:
            texts, labels = texts_of(rb.column("text")), np.asarray(rb.column("label")).astype(np.int64)
            for a, b in _text_blocks(texts):
                owner, gram = present(texts[a:b], None)
                held.append(_summed([(gram, np.int64(1) << (32 * labels[a:b])[owner])]))
                fresh += len(held[-1][0])
                if fresh > HELD_GRAMS // 2:
                    held, fresh = [_summed(held)], 0
                    if len(held[0][0]) > HELD_GRAMS:
                        yield from out(*held.pop())
        if held:
            yield from out(*_summed(held))

    # counted after the shuffle only, as a task's n-grams are distinct
    counts = rows.mapInArrow(released(count), "gram bigint, neg bigint, pos bigint").repartition("gram").groupBy("gram").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    n0, n1 = float(sizes[0]), float(sizes[1])
    share = F.lit(n1 / total)
    df_ = F.col("neg") + F.col("pos")
    z = (F.col("pos") - df_ * share) / F.sqrt(df_ * share * (1 - share) + 1e-9)
    # only the n-grams that tell the classes apart leave the executors
    told = materialise(counts.where(df_ >= 3).withColumn("z", z), "grams")
    top = [told.where(side).orderBy(F.abs("z").desc(), "gram").limit(most).toPandas() for side, most in ((F.col("z") > 0, max_features), (F.col("z") < 0, max_against))]
    discard(told)
    best = pd.concat(top).sort_values("gram")
    if best.empty:
        return Model(constant=n1 / total)
    p, q = best["pos"].to_numpy() + alpha, best["neg"].to_numpy() + alpha
    r = np.log((p / (n1 + 2 * alpha)) / (q / (n0 + 2 * alpha)))
    model = Model(best["gram"].to_numpy().astype(np.int64), np.zeros(len(best)))
    fit_schema = pa.schema([("label", pa.int32()), ("feats", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])

    def features(batches):
        for rb in batches:
            texts = texts_of(rb.column("text"))
            feats: list[np.ndarray] = []
            parts: list[np.ndarray] = []
            for a, b in _text_blocks(texts):
                owner, feat, part = shares(texts[a:b], model)
                cuts = np.searchsorted(owner, np.arange(1, b - a))
                feats += np.split(feat.astype(np.int32), cuts)
                parts += np.split(part.astype(np.float32), cuts)
            yield batch({"label": rb.column("label"), "feats": feats, "shares": parts}, fit_schema)

    got = rows.select("text", "label").mapInArrow(features, "label int, feats array<int>, shares array<float>").toPandas()
    if got.empty:
        return Model(constant=n1 / total)
    w, model.bias = _fit(list(got["feats"]), list(got["shares"]), got["label"].to_numpy().astype(float), r, l2, steps)
    model.weight = w * r
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, one row for each row of docs."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for rb in batches:
            s = score_texts(texts_of(rb.column("text")), shared.value)
            yield batch({"doc_id": rb.column("id"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}, schema)

    return dealt(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).mapInArrow(released(run), "doc_id bigint, score double, predicted int")


def label_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows to learn from, at most max_rows, first by a hash of the id: those with a label whose
    crc32(id as text) mod 5 is not 0. The ids are chosen without their texts; as there are at most
    max_rows of them they can be broadcast, and no text is shuffled. Returns id, text, label."""
    may = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0
    lab = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).where(may & F.col("label").isin(0, 1))
    ids = docs.select(F.col("doc_id").alias("id"))
    chosen = lab.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    return docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, in docs' own columns. A row without id is scored like any other."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(label_rows(docs, labels)))
    at = docs.columns.index("text")

    def run(batches):
        for rb in batches:
            s = score_texts(texts_of(rb.column(at)), model.value)
            yield rb.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)
