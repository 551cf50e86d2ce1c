import itertools

import numpy as np

from gridloom.llm import jaccard_join as J


def brute(rows):
    """{row number: (class id, links)} by comparing every pair."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((rows[i][0], least[root(i)], links[i]) for i in range(len(rows)))


def corpus():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(40):
        words = [f"w{rng.integers(0, 5000)}" for _ in range(int(rng.integers(1, 120)))]
        for _ in range(int(rng.integers(1, 12))):
            own = list(words)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, rows[0][1]), (n + 3, rows[0][1])]


def test_equals_brute_force_with_blocks_of_any_size(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, class_id int")
    for most in (2048, 3):
        monkeypatch.setattr(J, "BLOCK_ROWS", most)
        got = J.join(df)
        assert got.columns == ["doc_id", "class_id", "n_links"]
        assert sorted(map(tuple, got.collect())) == brute(rows)
    kept = J.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c, _ in brute(rows)}


def test_ids_with_several_texts(spark):
    rng = np.random.default_rng(4)
    a, b = (" ".join(f"{k}{x}" for x in rng.integers(0, 10**6, 100)) for k in "ab")
    for rows in ([(1, a), (1, b), (2, a + " z"), (3, b + " z")], [(1, a), (1, a + " w"), (2, a + " z"), (3, a + " w y")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, J.join(df).collect())) == brute(rows)


def test_an_id_of_many_rows_sends_each_vertex_one_text(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
    texts = [" ".join([*base, f"z{k}"]) for k in range(30)]
    rows = [(1, t) for t in texts for _ in range(5)] + [(2, " ".join(base))]
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    held = J._verify

    def verify(group, *more):
        assert len(set(group["v"])) == len(group["text"])
        return held(group, *more)

    monkeypatch.setattr(J, "_verify", verify)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, J.join(df).collect())) == brute(rows)


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    long = [f"w{x}" for x in rng.integers(0, 10**6, 150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:140_000])), (3, " ".join(long[:100])), (4, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.join(df).collect())) == brute(rows)


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert J.join(df.limit(0)).count() == 0 and J.keep_one(df.limit(0)).count() == 0
    assert [tuple(r) for r in J.join(df).collect()] == [(None, None, 0)]
    assert J.keep_one(df).count() == 1


def test_bands_reach_the_recall():
    b, r = J.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 150


def test_repeated_ids_are_judged_by_row(spark):
    rng = np.random.default_rng(5)
    a, b, c, d = (" ".join(f"{k}{x}" for x in rng.integers(0, 10**6, 100)) for k in "abcd")
    near = c.rsplit(" ", 1)[0] + " other"
    rows = [(5, a, 1), (5, a, 2), (5, a, 3), (7, b, 4), (7, near, 5), (3, c, 6), (9, d, 7), (9, d, 8), (8, d, 9), (None, d, 10), (None, d, 11), (4, None, 12), (4, None, 13)]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    n = {r["n"] for r in kept}
    assert len(kept) == len(n) and len(n & {1, 2, 3}) == 1
    assert n - {1, 2, 3} == {4, 6, 9, 10, 11, 12, 13}
