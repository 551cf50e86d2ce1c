import hashlib
from collections import Counter

import numpy as np

from gridloom.llm import suffix_dedup as D
from gridloom.llm.suffix_family import SuffixFamily


def brute(rows, depth=D.DEPTH):
    seen = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        seen.update(raw[i : i + depth] for i in range(len(raw) - depth + 1))
    out = []
    for (doc, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - depth + 1):
            if seen[raw[i : i + depth]] > 1:
                gone[i] += 1
                gone[i + depth] -= 1
        cover = np.cumsum(gone)[:-1] > 0
        left = bytes(np.frombuffer(raw, np.uint8)[~cover]) if len(raw) else b""
        n_spans = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(raw) else 0
        out.append((doc, len(raw), int(cover.sum()), n_spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=5, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(k) for k in (20, 45, 50, 60, 200)]
    rows = []
    for i in range(n):
        parts = [text(int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(0, len(shared)))]
            a = int(rng.integers(0, 60))
            parts += [s[a : a + int(rng.integers(150, 900))], text(int(rng.integers(0, 30)))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 199), (103, "b" * 200), (104, "c" * 201), (105, "xy" * 400), (106, rows[3][1]), (107, rows[4][1]), (107, rows[4][1]), (None, rows[5][1] + "z")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, found int")
    assert sorted(map(tuple, D.spans(df).collect()), key=str) == brute(rows)


def test_runs_found_are_not_written_apart(spark, monkeypatch):
    rows, kinds, write = corpus(10), [], D.materialise
    monkeypatch.setattr(D, "MOST_CONTEXTS", 3)
    monkeypatch.setattr(D, "materialise", lambda df, kind="stage", path=None: kinds.append(kind) or write(df, kind, path))
    assert sorted(map(tuple, D.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)
    assert "parts0" in kinds and "repeats" in kinds
    assert not [k for k in kinds if k.startswith(("arrays", "found"))]


def test_hot_anchors_and_chunks(spark, monkeypatch):
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    monkeypatch.setattr(D, "BATCH_BYTES", 3000)
    for most in (1, 3):
        monkeypatch.setattr(D, "MOST_CONTEXTS", most)
        assert sorted(map(tuple, D.spans(df).collect()), key=str) == want


def test_texts_of_many_chunks(spark):
    rng = np.random.default_rng(9)
    raw = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage, long = raw(700), raw(1_300_000)
    rows = [(1, long[:262_100] + passage + long[262_100:]), (2, raw(50) + passage[100:] + raw(90)), (3, long[1_048_400:1_048_900]), (4, "q" * 1_100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, D.spans(df).collect())) == brute(rows)


def ranges(found):
    return {(r["doc"], r["crc"]): D.union_of(r["found"]) for r in found.collect()}


def test_stored_index_takes_further_batches(spark, monkeypatch, tmp_path):
    """After each batch the index knows what one index of all rows so far would; it is opened anew for each."""
    rows = corpus(8, 90)
    for most, task, ends in ((2000, 4_000_000, (0, 40, 48, 90)), (3, 6000, (0, 30, 90, len(rows)))):
        monkeypatch.setattr(D, "MOST_CONTEXTS", most)
        monkeypatch.setattr(D, "TASK_BYTES", task)
        path, sizes = None, []
        for a, b in zip(ends, ends[1:], strict=False):
            index = D.SuffixIndex(spark, path)
            index.add(spark.createDataFrame(rows[a:b], "doc_id long, text string"))
            path = index.path
            sizes.append([level["size"] for level in index.levels["0"]])
            index.finish()
            again = D.SuffixIndex(spark, path)
            assert again.adds == index.adds
            upto = D.SuffixIndex(spark, keep=False)
            upto.add(spark.createDataFrame(rows[:b], "doc_id long, text string"))
            assert ranges(again.repeats()) == ranges(upto.repeats())
        assert all(x > 2 * y for s in sizes for x, y in zip(s, s[1:], strict=False))


def test_strip(spark):
    rows = corpus(7, 20)
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, a string")
    got = D.strip(df)
    assert got.columns == df.columns and got.count() == len(rows)
    whole = {(r["doc_id"], r["n_removed"]) for r in D.spans(df).collect() if r["n_removed"] == 0}
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert all(texts[d] == dict(rows)[d] for d, _ in whole)
    assert D.spans(df.limit(0)).count() == 0 and D.strip(df.limit(0)).count() == 0


def test_family_merges_geometrically():
    rng = np.random.default_rng(8)
    family = SuffixFamily(8)
    strings, names = [], []
    for _ in range(40):
        batch = [bytes(rng.integers(97, 100, int(rng.integers(8, 40))).astype(np.uint8)) for _ in range(5)]
        n = np.array([len(s) - 7 for s in batch])
        first = family.add(batch, n)
        assert first == len(names)
        for s, k in zip(batch, n, strict=True):
            names += [s[i : i + 8] for i in range(k)]
    count = Counter(names)
    assert [count[x] > 1 for x in names] == list(family.matched)
    sizes = [len(level.at) for level in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) <= len(names)
