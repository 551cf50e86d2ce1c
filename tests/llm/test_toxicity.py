import zlib

import numpy as np
import pytest

from gridloom.llm import toxicity as T

BAD = ["moron", "trash", "clown"]


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["the", "cat", "sat", "on", "mat", "train", "crown", "rash", "more", "of", "house", "tree"]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, int(rng.integers(5, 80))))
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(2):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(BAD)))
        docs.append((i, " ".join(text), "en"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(T.label_rows(d, lab))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in T.score(d, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    truth = {i: t for i, _, t in labels}
    assert np.mean([got[i][1] == truth[i] for i in held]) > 0.98
    assert all(p == int(s >= 0.5) and 0 <= s <= 1 for s, p in got.values())
    kept = T.keep_clean(d, lab)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, p) in got.items() if p == 0}
    # held-out labels are never learned from
    flipped = spark.createDataFrame([(i, q, 1 - t if i in set(held) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = T.train(T.label_rows(d, flipped))
    assert np.array_equal(again.weight, model.weight) and again.bias == model.bias


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    feats = np.unique(rng.integers(0, 1 << T.BITS, 200_000))
    model = T.Model(feats, rng.standard_normal(len(feats)) * 0.01, -1.0)
    texts = ["", "a", "moron", "é日😀", "x" * 50_000, "moron", "\0\0\0", "Moron TRASH"]
    whole = T.score_texts(texts, model)
    assert np.allclose(whole, [T.score_texts([t], model)[0] for t in texts]) and whole[2] == whole[5]


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, "moron"), (1, "moron"), (2, None), (None, "x"), (3, "")], "doc_id long, text string")
    for rows, want in (([], 0.0), ([(1, 1), (3, 1)], None), ([(1, None), (2, 7)], 0.0)):
        lab = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = T.score(d, T.train(T.label_rows(d, lab))).collect()
        assert len(got) == 5 and len({r["score"] for r in got}) == 1
        if want is not None:
            assert got[0]["score"] == want
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    model = T.train(T.label_rows(d, lab))
    assert T.score(d, model).count() == 5 and T.score(d.limit(0), model).count() == 0
    assert T.keep_clean(d.limit(0), lab).count() == 0


@pytest.mark.parametrize("texts", [["ab", "cd"], ["abc"]])
def test_presence_is_counted_once(texts):
    owner, feat = T.present([t * 3 for t in texts], None)
    assert len(set(zip(owner.tolist(), feat.tolist(), strict=True))) == len(owner)


def test_long_clean_texts_stay(spark):
    """Clean texts of 0.1 to 5 MB are made of many words never met; a toxic text is toxic at any length."""
    rng = np.random.default_rng(2)
    parts = ["ba", "do", "ke", "li", "mu", "ra", "so", "ti", "ve", "zan", "pher", "quil", "nost", "gra", "wick"]
    words = np.array(["".join(rng.choice(parts, int(n))) for n in rng.integers(1, 5, 60_000)])
    docs, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, int(rng.integers(50, 400))))
        toxic = int(i % 8 == 0)
        for _ in range(toxic * (2 + len(text) // 60)):
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(BAD)))
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(T.label_rows(d, lab))
    assert (model.weight > 0).any() and (model.weight < 0).any()
    clean = [" ".join(rng.choice(words, n)) for n in (16_000, 80_000, 160_000, 800_000)]
    assert 90_000 < len(clean[0]) and len(clean[-1]) > 4_500_000
    foul = clean[1].replace(" do", " moron do")
    assert [p >= 0.5 for p in T.score_texts([*clean, foul], model)] == [False] * 4 + [True]
    long = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    kept = T.keep_clean(d.union(long), lab).where("doc_id >= 1000")
    assert kept.count() == 4


def test_shares_are_of_equal_segments_and_blocks_do_not_show(monkeypatch):
    text = "moron " + "x" * 3990 + " moron trash" + "y" * 4000
    names = np.unique(T.present(["moron"], None)[1])
    model = T.Model(names, np.ones(len(names)), 0.0)
    want = T.shares(["a", text, text[:2000]], model)
    assert set(want[2][want[0] == 1]) <= {0.25, 0.5} and 0.5 in want[2] and set(want[2][want[0] == 2]) == {1.0}
    monkeypatch.setattr(T, "BLOCK_CHARS", 97)
    assert all(np.array_equal(a, b) for a, b in zip(want, T.shares(["a", text, text[:2000]], model), strict=True))
    assert len(T.present([text], None)[1]) == len(set(T.present([text], None)[1]))

def test_counts_do_not_depend_on_when_a_task_hands_them_on(spark, monkeypatch):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").coalesce(1)
    rows = T.label_rows(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = T.train(rows, steps=5)
    monkeypatch.setattr(T, "HELD_GRAMS", 50)
    monkeypatch.setattr(T, "BLOCK_CHARS", 2000)
    got = T.train(rows, steps=5)
    assert np.array_equal(got.features, want.features) and np.allclose(got.weight, want.weight)


def windows(text):
    """n-gram and place of every n-gram of a text, those that reach over its ends included."""
    s = "\0" * T.PAD + text.lower() + "\0" * T.PAD
    return [(s[p : p + k], p) for k in T.ORDERS for p in range(len(text) + T.PAD)]


def name_of(gram):
    codes = np.array([*map(ord, gram), *[0] * (T.PAD + 1)], np.uint32)
    return int(list(T._grams(codes, 0, 1))[T.ORDERS.index(len(gram))][0])


def test_features_and_scores_equal_dictionaries(spark):
    docs, labels = corpus(150, 7)
    truth = {i: t for i, _, t in labels}
    rows = [(i, text, truth[i]) for i, text, _ in docs] + [(1, docs[1][1], truth[1])] + [(500, None, 1), (501, "", 0), (502, "x", None)]
    model = T.train(spark.createDataFrame(rows, "id long, text string, label int"), max_features=40, max_against=10)
    learnt = {(i, t, y) for i, t, y in rows if y is not None}
    seen = {0: {}, 1: {}}
    for _, text, y in learnt:
        for g in {g for g, _ in windows(text or "")}:
            seen[y][g] = seen[y].get(g, 0) + 1
    n = {y: sum(1 for r in learnt if r[2] == y) for y in (0, 1)}
    share = n[1] / (n[0] + n[1])

    def z(g):
        both = seen[0].get(g, 0) + seen[1].get(g, 0)
        return (seen[1].get(g, 0) - both * share) / np.sqrt(both * share * (1 - share) + 1e-9)

    grams = [g for g in {*seen[0], *seen[1]} if seen[0].get(g, 0) + seen[1].get(g, 0) >= 3]
    names = {g: name_of(g) for g in grams}
    for_it = sorted((g for g in grams if z(g) > 0), key=lambda g: (-round(z(g), 9), names[g]))[:40]
    against = sorted((g for g in grams if z(g) < 0), key=lambda g: (round(z(g), 9), names[g]))[:10]
    assert {names[g] for g in for_it + against} == set(model.features.tolist())
    # the log-count ratio is a factor of each weight; what is fitted besides is the same for equal columns
    ratio = {names[g]: np.log((seen[1].get(g, 0) + 1) / (n[1] + 2)) - np.log((seen[0].get(g, 0) + 1) / (n[0] + 2)) for g in for_it + against}
    assert all(abs(ratio[f]) > 1e-12 or w == 0 for f, w in zip(model.features.tolist(), model.weight, strict=True))
    weight = dict(zip(model.features.tolist(), model.weight, strict=True))
    by_name = {names[g]: g for g in for_it + against}
    for text in ["", "a", docs[3][1], docs[4][1], " ".join(t for _, t, _ in docs[:60]), "Moron TRASH the cat"]:
        segments = max(1, (len(text) + T.SEGMENT // 2) // T.SEGMENT)
        held = {(g, p * segments // (len(text) + T.PAD)) for g, p in windows(text)}
        logit = model.bias + sum(weight[f] * sum((g, s) in held for s in range(segments)) / segments for f, g in by_name.items())
        assert abs(T.score_texts([text], model)[0] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_training_is_bounded(spark):
    docs, labels = corpus(120, 9)
    truth = {i: t for i, _, t in labels}
    rows = [(i, text, truth[i]) for i, text, _ in docs] + [(7, "the same", 0)] * 200
    df = spark.createDataFrame(rows, "id long, text string, label int")
    assert T.bounded(df, 50).count() == 50 and T.bounded(df, 1000).count() == 121
    assert sorted(map(tuple, T.bounded(df, 50).collect())) == sorted(map(tuple, T.bounded(df.repartition(5), 50).collect()))
    assert T.train(df, max_rows=50).constant is None
