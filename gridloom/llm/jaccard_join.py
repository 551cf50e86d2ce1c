"""N-gram Jaccard join by MinHash banding.

A document's set holds the hashes of its five-word shingles. Rows and bands of the MinHash signature are
chosen for a target recall at the threshold. Documents with equal sets form one class, of which only the
least id goes on. Representatives that share a band's hash are candidates; the shuffle on band hashes only
links each of them to the least id of its bucket, so a bucket of any size costs one row for each member.
Connected candidates are cut into blocks, in which those that agree in their first band stand together. Within
each block, and between blocks that share a band's hash, every pair is verified on the full sets, in a
task for each pair of blocks; so no task grows with a component, no pair is ever emitted, and no link between two
candidates is lost to a cap. Verified pairs add to each document's number of links; their spanning forests give
the classes.

Defined results: words are separated by white space and compared in lower case; a text of one to four
words is one shingle; null texts, texts without words and rows without id have no set, link to nothing and are
classes of their own. Every row counts as a document: rows that repeat an id and its text link to each other, and of
an id with several texts each text has its own set, links and class. Texts of any length are taken whole; ties of the
least id cannot be told apart and need not be. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, dealt, discard, materialise, released, texts_of, tune
from .components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: A block of a component holds about this many representatives or this many shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000


def bands_for(threshold: float, recall: float, most: int = 150) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands of at most ``most`` hashes in all find a pair at the threshold with the recall."""
    best = (most, 1)
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


_HASHES: dict[str, int] = {}


def _word_hash(word: str) -> int:
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        h = _HASHES[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(found) if len(found) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), 512):
        part = low[s : s + 512, None] * a[None, :]
        part ^= b[None, :]
        part *= np.uint32(0x9E3779B1)
        np.minimum(out, part.min(axis=0), out=out)
    return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signed(docs: DataFrame, threshold: float, recall: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text's digest, a 128-bit name of its set (null without words), the set's size, and a hash for each band."""
    tune(docs.sparkSession)
    n_bands, n_rows = bands_for(threshold, recall)

    def run(batches):
        a, b = _permutations(n_bands * n_rows)
        for rb in batches:
            cols: dict[str, list] = {f.name: [] for f in SIGNED}
            known: dict[bytes, np.ndarray] = {}
            for doc, digest, text in zip(rb.column("id").to_pylist(), rb.column("digest").to_pylist(), texts_of(rb.column("text")), strict=True):
                found = shingles(text, words)
                cols["doc_id"].append(doc)
                cols["digest"].append(digest)
                cols["size"].append(len(found))
                if not len(found):
                    for k in ("set_a", "set_b", "bands"):
                        cols[k].append(None)
                    continue
                name = xxhash.xxh3_128_digest(found.tobytes())
                if name not in known:
                    sig = signature(found, a, b).reshape(n_bands, n_rows)
                    known[name] = np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(sig)], np.uint64).view(np.int64)
                one, two = np.frombuffer(name, np.int64)
                cols["set_a"].append(int(one))
                cols["set_b"].append(int(two))
                cols["bands"].append(known[name])
            yield batch(cols, SIGNED)

    ddl = "doc_id bigint, digest bigint, set_a bigint, set_b bigint, size bigint, bands array<bigint>"
    return dealt(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))).mapInArrow(released(run), ddl)


def _similar(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    return inter >= threshold * (na + nb - inter) - 1e-9


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: which sets of left and right reach the threshold. Counts common shingles by matrix products
    over slices of those shingles that both sides hold."""
    nl, nr = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    if len(left) * len(right) <= 64:
        out = np.zeros((len(left), len(right)), bool)
        for i, s in enumerate(left):
            for j, t in enumerate(right):
                if min(nl[i], nr[j]) >= threshold * max(nl[i], nr[j]) - 1e-9:
                    out[i, j] = _similar(len(np.intersect1d(s, t, assume_unique=True)), nl[i], nr[j], threshold)
        return out
    a, b = np.concatenate(left), np.concatenate(right)
    ra, rb = np.repeat(np.arange(len(left)), nl), np.repeat(np.arange(len(right)), nr)
    common = np.intersect1d(a, b)
    ca, cb = np.searchsorted(common, a), np.searchsorted(common, b)
    ka = (ca < len(common)) & (common[np.minimum(ca, len(common) - 1)] == a) if len(common) else np.zeros(len(a), bool)
    kb = (cb < len(common)) & (common[np.minimum(cb, len(common) - 1)] == b) if len(common) else np.zeros(len(b), bool)
    ca, ra, cb, rb = ca[ka], ra[ka], cb[kb], rb[kb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    inter = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for s in range(0, len(common), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        i, j = np.searchsorted(ca, [s, s + step])
        x[ra[i:j], ca[i:j] - s] = 1
        i, j = np.searchsorted(cb, [s, s + step])
        y[rb[i:j], cb[i:j] - s] = 1
        inter += x @ y.T
    return _similar(inter, nl[:, None], nr[None, :], threshold)


def _forest(hit: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the bipartite links hit between the vertices one (rows) and two (columns)."""
    edges: list[tuple[int, int]] = []
    fresh, seen_rows = np.ones(len(two), bool), np.zeros(len(one), bool)
    for start in np.flatnonzero(hit.any(axis=1)):
        if seen_rows[start]:
            continue
        seen_rows[start] = True
        todo = [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(hit[i] & fresh):
                fresh[j] = False
                edges.append((one[i], two[j]))
                more = np.flatnonzero(hit[:, j] & ~seen_rows)
                seen_rows[more] = True
                edges += [(one[m], two[j]) for m in more]
                todo += list(more)
    return edges


#: A vertex is a number given to a set once, in a written table: an id with several texts is several vertices.
VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
VERIFIED_DDL = "a bigint, b bigint, links bigint"


def _verify(group: dict[str, list], threshold: float, words: int) -> dict[str, list]:
    """Links and a spanning forest of one pair of blocks. Rows without b hold links of a; others are edges."""
    sets = [shingles(t, words) for t in group["text"]]
    vertices = group["v"]
    copies, side = (np.array(group[c], np.int64) for c in ("copies", "side"))
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    out: dict[str, list] = {f.name: [] for f in VERIFIED}
    if not len(one) or not len(two):
        return out
    hit = linked([sets[i] for i in one], [sets[i] for i in two], threshold)
    if (side == 2).all():
        np.fill_diagonal(hit, False)
    # a diagonal task meets each pair from both sides, so only links of its rows count there
    links = np.zeros(len(vertices), np.int64)
    links[one] += hit @ copies[two]
    if not (side == 2).all():
        links[two] += copies[one] @ hit
    some = np.flatnonzero(links)
    edges = _forest(hit, one, two)
    out["a"] = [*(vertices[i] for i in some), *(vertices[i] for i, _ in edges)]
    out["b"] = [*[None] * len(some), *(vertices[j] for _, j in edges)]
    out["links"] = [*links[some], *[0] * len(edges)]
    return out


def _blocks(placed: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """placed with ``block``: within a component, vertices that agree in their first band stand together, in as many blocks
    as their number and size ask for. Each join is written apart, so that a large component is split there."""
    size = lambda of: F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(of) / BLOCK_SHINGLES), F.lit(1))
    whole = placed.groupBy("label").agg(size("size").alias("near"))
    near = written(placed.join(whole, "label").withColumn("near", F.pmod(F.xxhash64(F.col("bands")[0]), F.col("near"))), "near")
    cut = near.groupBy("label", "near").agg(size("size").alias("cuts"))
    cut = near.join(cut, ["label", "near"]).withColumn("cut", F.pmod(F.xxhash64("v"), F.col("cuts")))
    return cut.withColumn("block", F.col("near") * (1 << 31) + F.col("cut")).drop("near", "cut", "cuts")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links. class_id: the least id of the documents joined by chains of links; n_links: with how
    many other documents this one's similarity reaches the threshold."""
    spark = docs.sparkSession
    temporary: list[DataFrame] = []

    def written(df: DataFrame, kind: str) -> DataFrame:
        temporary.append(materialise(df, kind))
        return temporary[-1]

    rows = written(signed(docs, threshold, recall, words, id_col, text_col), "signed")
    name = ["set_a", "set_b"]
    reps = written(
        rows.where("size > 0 and doc_id is not null")
        .groupBy(*name)
        .agg(F.min(F.struct("doc_id", "digest")).alias("row"), F.count("*").alias("copies"), F.min("size").alias("size"), F.first("bands").alias("bands"))
        .select(*name, F.col("row.doc_id").alias("rep"), F.col("row.digest").alias("digest"), "copies", "size", "bands")
        .withColumn("v", F.monotonically_increasing_id()),
        "reps",
    )
    members = reps.select("v", F.posexplode("bands").alias("band", "hash"))
    # written apart, so that the join's sides are plain shuffles, of which a hot bucket can be split
    shared = written(members.groupBy("band", "hash").agg(F.min("v").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    links = members.join(shared, ["band", "hash"]).where("v <> leader").select(F.col("leader").alias("a"), F.col("v").alias("b"))
    label = components(links)
    temporary.append(label)
    labelled = written(label.withColumnRenamed("id", "v").join(reps.select("v", "rep", "digest", "copies", "size", "bands"), "v"), "labelled")
    placed = written(_blocks(labelled, written), "placed")
    # blocks of a component that share a band's hash meet; a bucket gives a row for each block in it, not for each vertex
    held = placed.select("label", "block", F.posexplode("bands").alias("band", "hash")).distinct()
    one, two = held.withColumnRenamed("block", "i"), held.withColumnRenamed("block", "j")
    met = one.join(two, ["label", "band", "hash"]).where("i < j").select("label", "i", "j").distinct()
    both = met.select("label", "i", "j", F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))).alias("m"))
    alone = placed.select("label", F.col("block").alias("i"), F.col("block").alias("j"), "block", F.lit(2).alias("side")).distinct()
    meets = written(both.select("label", "i", "j", "m.block", "m.side").unionByName(alone), "meets")
    dealt_out = placed.select("v", "rep", "digest", "copies", "size", "label", "block").join(meets, ["label", "block"])
    task = written(dealt_out.select("v", "rep", "digest", "copies", "size", F.xxhash64("label", "i", "j").alias("task"), "side"), "tasks")
    shingled = task.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(shingled) // BLOCK_SHINGLES))
    # a vertex asks for one text of its id, so an id may have any number of rows; those that repeat one text are made one first
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    texts = texts.groupBy("rep", "digest").agg(F.first("text").alias("text"))
    # the same join at every size: a table that happens to be small is not broadcast
    spread = texts.join(task.hint("merge"), ["rep", "digest"]).select("v", "copies", "task", "side", "text").repartition(parts, "task").sortWithinPartitions("task")

    def run(batches):
        group: dict[str, list] = {}
        key = None
        out: dict[str, list] = {f.name: [] for f in VERIFIED}
        for rb in batches:
            cols = {c: rb.column(c).to_pylist() for c in rb.schema.names}
            for r in range(rb.num_rows):
                k = cols["task"][r]
                if k != key:
                    if key is not None:
                        for c, v in _verify(group, threshold, words).items():
                            out[c] += v
                        if len(out["links"]) > 10_000:
                            yield batch(out, VERIFIED)
                            out = {f.name: [] for f in VERIFIED}
                    key, group = k, {c: [] for c in ("v", "copies", "side", "text")}
                for c in group:
                    group[c].append(cols[c][r])
        if key is not None:
            for c, v in _verify(group, threshold, words).items():
                out[c] += v
        yield batch(out, VERIFIED)

    verified = written(spread.mapInArrow(released(run), VERIFIED_DDL), "verified")
    n_links = verified.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
    found = components(verified.where("b is not null").select("a", "b"))
    temporary.append(found)
    ranked = written(found.withColumnRenamed("id", "v").join(reps.select("v", "rep"), "v"), "ranked")
    # written apart, so that a class of very many sets is split there
    classes = written(ranked.join(ranked.groupBy("label").agg(F.min("rep").alias("class_id")), "label").select("v", "class_id"), "of-class")
    known = reps.select(*name, "rep", "copies", "v").join(n_links, "v", "left").join(classes, "v", "left")
    known = known.select(*name, F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = rows.where("size > 0 and doc_id is not null").select("doc_id", *name).join(known, name).select("doc_id", "class_id", "n_links")
    lone = rows.where("size = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    result = materialise(named.unionByName(lone), "classes")
    discard(*temporary)
    return result


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, of the least id, in docs' own columns. Rows are told apart by a number, written
    apart so that it holds: of rows that repeat an id and its text one stays, and of an id with several texts each
    row is judged by its own text. Rows without id stay."""
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    # a row without id has no set here, so it is a class of its own
    classes = join(numbered.select("_row", F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text")), id_col="_row")
    ids = numbered.select("_row", F.col("doc_id").alias("id"))
    least = classes.withColumnRenamed("doc_id", "_row").join(ids, "_row").groupBy("class_id").agg(F.min(F.struct("id", "_row")).alias("least"))
    return numbered.join(least.select("least._row"), "_row", "left_semi").select(*docs.columns)
