"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors is fitted on the driver: its neighbour graph under the inner product is cut into
balanced parts by recursive spectral bisection and refined by moves that keep the balance, and a small
network learns to tell the parts of a vector's neighbours. Every row is then indexed by the part the network
finds most probable, and a query visits the several most probable parts, as many as the recall of sample rows that
the fit has not seen asks for, and further ones until those visited hold enough rows for all its ranks. In
each part visited all rows are scored in double precision; the best of all parts are merged.

Small parts are grouped, and groups dealt to tasks in blocks of about ``BLOCK_ROWS`` rows and queries, so a query's
vector goes once to each block, a part that holds a third of all rows is many tasks, and ties at the last rank are settled exactly among all rows visited.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length is not the commonest (of equally common lengths the larger); rows that repeat a query's id are the
query's own and no candidates of it, and such a query is asked once; other repeated rows are candidates each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, materialise, tune

#: Rows that the index is fitted on.
MAX_SAMPLE = 16_384
NEIGHBOURS = 20
#: Rows of a part in one block of work, and queries in one.
BLOCK_ROWS = 4096
#: Rows that a part should hold, and how many of the sample it takes at least to learn a part.
PART_ROWS, PART_SAMPLE = 500, 48
TARGET_RECALL = 0.97
#: Rows that are scored against the whole sample at once on the driver.
LOT = 128


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec: the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null").where(fine)
    size = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("vec") == (size["d"] if size else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k others with the largest inner product."""
    n, out = len(x), []
    for a in range(0, n, LOT):
        g = x[a : a + LOT] @ x.T
        g[np.arange(len(g)), np.arange(a, a + len(g))] = -np.inf
        top = np.argpartition(-g, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(g, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0, slack: float = 0.1) -> np.ndarray:
    """A part for each row, parts a power of two: recursive bisection at the median of a smooth vector over the
    graph, then moves towards the part of most neighbours while no part exceeds its share by more than slack."""
    n, k = graph.shape
    rng = np.random.default_rng(seed)
    src = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    dst = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    label = np.zeros(n, np.int64)
    for level in range(int(np.log2(parts))):
        inside = label[src] == label[dst]
        s, d = src[inside], dst[inside]
        degree = np.bincount(s, minlength=n) + 1.0
        size = np.bincount(label, minlength=1 << level)
        v = rng.standard_normal(n)
        for _ in range(60):
            v = (np.bincount(s, weights=v[d], minlength=n) + v) / degree
            v -= (np.bincount(label, weights=v * degree, minlength=1 << level) / np.maximum(np.bincount(label, weights=degree, minlength=1 << level), 1))[label]
            v /= np.sqrt(np.bincount(label, weights=v * v, minlength=1 << level) / np.maximum(size, 1) + 1e-30)[label]
        order = np.lexsort((v, label))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        label = label * 2 + (place >= (size / 2)[label])
    room = int(np.ceil(n / parts * (1 + slack)))
    size = np.bincount(label, minlength=parts)
    for _ in range(8):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (src, label[dst]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network with one hidden layer: which parts a vector's neighbours are likely in."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray, m: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :m]


def learn(x: np.ndarray, target: np.ndarray, hidden: int = 256, epochs: int = 40, seed: int = 0) -> Router:
    """Softmax cross-entropy against target, a distribution over parts for each row, by Adam."""
    rng = np.random.default_rng(seed)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    n, d = x.shape
    p = [rng.standard_normal((d, hidden)) * np.sqrt(2.0), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * np.sqrt(1 / hidden), np.zeros(target.shape[1])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for idx in np.array_split(rng.permutation(n), max(1, n // 256)):
            h = np.maximum(x[idx] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - target[idx]) / len(idx)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((x[idx].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i] += 0.1 * (grad - m[i])
                v[i] += 0.001 * (grad * grad - v[i])
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit(sample: np.ndarray, total: int, k: int = NEIGHBOURS, target_recall: float = TARGET_RECALL) -> Router:
    """total: rows that the index will hold. The number of parts follows it as far as the sample bears."""
    n, d = sample.shape
    parts = 1
    while parts * 2 * PART_SAMPLE <= n and parts * PART_ROWS < total:
        parts *= 2
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    # how many parts must be visited is measured on sample rows left out of the fit, against their exact neighbours in the sample
    order = np.random.default_rng(1).permutation(n)
    held, learnt = np.split(order, [min(1000, n // 10)])
    seen = sample[np.sort(learnt)]
    graph = neighbour_graph(seen, min(10, len(seen) - 1))
    label = balanced_parts(graph, parts)
    target = np.zeros((len(seen), parts))
    np.add.at(target, (np.repeat(np.arange(len(seen)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(seen)), label] += graph.shape[1]
    router = learn(seen, target / target.sum(axis=1, keepdims=True))
    true = []
    for lot in np.array_split(held, -(-len(held) // LOT)):
        score = sample[lot] @ sample.T
        score[np.arange(len(lot)), lot] = np.inf  # itself, cut off below
        true.append(np.argpartition(-score, min(k, n - 1), axis=1)[:, : min(k, n - 1) + 1])
    true = np.concatenate(true)
    true = true[true != held[:, None]].reshape(len(held), -1)[:, : min(k, n - 1)]
    home = router.ranked(sample, 1)[:, 0]
    at = np.argsort(np.argsort(-router.logits(sample[held]), axis=1, kind="stable"), axis=1)
    rank = np.take_along_axis(at, home[true], axis=1)
    recall = [(rank < m).mean() for m in range(1, parts + 1)]
    router.probes = 1 + int(np.argmax(np.array(recall) >= target_recall))
    return router


def _top(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, visits: np.ndarray):
    """Of each query the k best of those of x that it visits, in order, ties to smaller ids: arrays of query place, id, score."""
    rough = q @ x.T
    rough[~visits | (qid[:, None] == xid[None, :])] = -np.inf
    kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
    scale = np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    row, col = np.nonzero((rough >= (kth - 1e-9 * scale)[:, None]) & (rough > -np.inf))
    exact = np.concatenate([(q[row[a : a + 50_000]] * x[col[a : a + 50_000]]).sum(axis=1) for a in range(0, len(row), 50_000)]) if len(row) else np.zeros(0)
    order = np.lexsort((xid[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    count = np.bincount(row, minlength=len(q))
    keep = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < k
    return row[keep], xid[col[keep]], exact[keep]


def grouped(held: np.ndarray, rows: int) -> np.ndarray:
    """A group for each part: parts side by side that hold about so many rows in all, large ones alone."""
    out, group, total = np.zeros(len(held), np.int64), 0, 0
    for part, n in enumerate(held):
        if total and total + n > rows:
            group, total = group + 1, 0
        out[part] = group
        total += int(n)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries its k best rows of vectors among the parts visited."""
    spark = vectors.sparkSession
    tune(spark)
    rows = usable(vectors, id_col, vec_col)
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("vec").toArrow()
    x = _matrix(sample.column("vec").combine_chunks()) if total else np.zeros((0, 1))
    del sample
    router = fit(x, total, k)
    shared = spark.sparkContext.broadcast(router)  # a few hundred kB, however many rows there are
    placed_schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))])

    def place(batches):
        for rb in batches:
            if rb.num_rows:
                part = shared.value.ranked(_matrix(rb.column("vec")), 1)
                yield batch({"part": part.ravel(), "id": rb.column("id"), "vec": rb.column("vec")}, placed_schema)

    index = materialise(rows.mapInArrow(place, "part int, id bigint, vec array<double>"), "index")
    held = np.zeros(router.parts, np.int64)
    for r in index.groupBy("part").agg(F.count("*").alias("n")).collect():  # a number for each of the parts, which the sample bounds
        held[r["part"]] = r["n"]
    group = grouped(held, BLOCK_ROWS)
    sizes = spark.sparkContext.broadcast((held, group))
    asked_schema = pa.schema([("group", pa.int32()), ("id", pa.int64()), ("parts", pa.list_(pa.int32()))])

    def ask(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            held, group = sizes.value
            part = shared.value.ranked(_matrix(rb.column("vec")), shared.value.parts)
            # rows of the query's own id are no candidates, so as many more must be visited, wherever they are
            short = np.cumsum(held[part], axis=1) < k + np.asarray(rb.column("own"))[:, None]
            most = np.maximum(shared.value.probes, np.minimum(short.sum(axis=1) + 1, part.shape[1]))
            at, rank = np.nonzero((np.arange(part.shape[1]) < most[:, None]) & (held[part] > 0))
            visited = part[at, rank]
            order = np.lexsort((visited, group[visited], at))
            at, visited = at[order], visited[order]
            to = group[visited]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (to[1:] != to[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array([*first, len(at)], pa.int32()), pa.array(visited, pa.int32()))
            yield batch({"group": to[first], "id": rb.column("id").take(pa.array(at[first])), "parts": lists}, asked_schema)

    wanted = usable(queries, id_col, vec_col).dropDuplicates(["id"])
    own_rows = index.groupBy("id").agg(F.count("*").alias("own"))
    asked = materialise(
        wanted.join(own_rows, "id", "left").select("id", "vec", F.coalesce("own", F.lit(0)).alias("own")).mapInArrow(ask, "group int, id bigint, parts array<int>"), "asked"
    )
    # blocks of each group: a few numbers for each of the parts, which the sample bounds
    of_part = F.broadcast(spark.createDataFrame([(p, int(g)) for p, g in enumerate(group)], "part int, group int"))
    rows_of = index.join(of_part, "part")
    count = lambda df, name: df.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    blocks = F.broadcast(count(rows_of, "bx").join(count(asked, "bq"), "group"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows_of.join(blocks, "group").select("group", own("bx").alias("sx"), every("bq").alias("sq"), F.lit(0).alias("query"), "id", "vec", F.array("part").alias("parts"))
    # a query's vector goes once to each block of rows, with the parts that it visits there
    right = asked.join(blocks, "group").join(wanted, "id").select("group", every("bx").alias("sx"), own("bq").alias("sq"), F.lit(1).alias("query"), "id", "vec", "parts")
    # about as many tasks as blocks of work, a partition holding a few
    n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).repartition(max(n_blocks, total // BLOCK_ROWS), "group", "sx", "sq").sortWithinPartitions("group", "sx", "sq", "query")
    found_schema = pa.schema([("query_id", pa.int64()), ("less", pa.float64()), ("vec_id", pa.int64())])

    def visit(batches):
        key, held, x, xid, xpart = None, [], None, None, None
        for rb in batches:
            if not rb.num_rows:
                continue
            keys = np.stack([np.asarray(rb.column(c)) for c in ("group", "sx", "sq", "query")], 1)
            ids, vecs = np.asarray(rb.column("id")), _matrix(rb.column("vec"))
            parts, ends = np.asarray(rb.column("parts").flatten()), np.cumsum(np.asarray(rb.column("parts").value_lengths()))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if tuple(keys[a, :3]) != key:
                    key, held, x = tuple(keys[a, :3]), [], None
                if keys[a, 3] == 0:
                    held.append((vecs[a:b], ids[a:b], parts[ends[a] - 1 : ends[b - 1]]))
                    continue
                if x is None:
                    if not held:
                        continue
                    x, xid, xpart = (np.concatenate(c) for c in zip(*held, strict=True))
                for s in range(a, b, 512):
                    e = min(b, s + 512)
                    owner = np.repeat(np.arange(e - s), np.diff(np.concatenate([[ends[s - 1] if s else 0], ends[s:e]])))
                    visits = np.zeros((e - s, router_parts), bool)
                    visits[owner, parts[(ends[s - 1] if s else 0) : ends[e - 1]]] = True
                    row, vid, score = _top(vecs[s:e], ids[s:e], x, xid, k, visits[:, xpart])
                    yield batch({"query_id": ids[s:e][row], "less": 0.0 - score, "vec_id": vid}, found_schema)

    router_parts = router.parts
    found = dealt.mapInArrow(visit, "query_id bigint, less double, vec_id bigint")
    # each task keeps a query's k best before they are shuffled, and again after
    order = Window.partitionBy("query_id").orderBy("less", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", (F.lit(0.0) - F.col("less")).alias("score"))
