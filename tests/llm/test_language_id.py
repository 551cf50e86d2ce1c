import math
from collections import Counter, defaultdict

import numpy as np

from gridloom.llm import language_id as L


def plain_bits(training, text):
    """The code length by walking the contexts one by one."""
    seen = [defaultdict(Counter) for _ in range(4)]
    for t in training:
        raw = b"\0\0\0" + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                seen[k][raw[i - k : i]][raw[i]] += 1
    total, raw = 0.0, b"\0\0\0" + text.encode()
    for i in range(3, len(raw)):
        out = set()
        for k in (3, 2, 1, 0):
            ctx = seen[k].get(raw[i - k : i])
            if ctx is None:
                continue
            left = {s: c for s, c in ctx.items() if s not in out}
            whole = sum(left.values()) + len(left)
            if raw[i] in left:
                total -= math.log2(left[raw[i]] / whole)
                break
            if whole:
                total -= math.log2(len(left) / whole)
            out |= set(ctx)
        else:
            total += math.log2(256 - len(out))
    return total


def tree_of(training):
    codes, n = np.unique(L._codes(training)[0], return_counts=True)
    return L.Tree(codes.astype(np.int64), n.astype(float))


def test_bits_equal_a_walk_over_contexts():
    training = ["banana bandana", "the cat sat on the mat", "über die brücke"]
    other = ["le chat est là", "où est la gare"]
    model = L.Model(["a", "b"], [tree_of(training), tree_of(other)])
    texts = ["banana", "the bat", "q", "zzz日本", "où", "", "b"]
    got = model.bits(texts)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, [plain_bits(training, t), plain_bits(other, t)], rtol=1e-5, atol=1e-4), t
    # a code: the probabilities of all bytes after a context sum to one
    for ctx in (b"ana", b"the", b"zzz", b"\0\0\0"):
        codes = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)])
        assert abs(np.exp2(-model.trees[0].bits(codes)).sum() - 1) < 1e-9


def test_large_tables_give_the_same(monkeypatch):
    model = L.Model(["a"], [tree_of(["some text of words"])])
    want = model.bits(["some other words"])
    monkeypatch.setattr(L, "MOST_PAIRS", 0)
    assert np.allclose(L.Model(["a"], model.trees).bits(["some other words"]), want)


def test_train_and_predict(spark):
    en, fr = "the cat sat on the mat with the other cats ", "le chat est sur la table avec les autres chats "
    rows = [(i, (en if i % 2 else fr) * 3, "en" if i % 2 else "fr") for i in range(40)] + [(50, None, "en"), (51, "x", None), (None, "", "fr")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    model = L.train(df, max_rows=15)
    assert model.langs == ["en", "fr"]
    test = spark.createDataFrame([(1, "the mat"), (1, "the mat"), (2, "la table"), (3, None), (4, "12 .\n"), (5, "the cat " * 50_000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in L.predict(test, model).collect())
    assert got == [(1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "en")]
    assert L.train(df.limit(0)).langs == []
    assert {r["lang_pred"] for r in L.predict(test, L.Model([], [])).collect()} == {"und"}
    assert L.predict(test.limit(0), model).count() == 0


def test_a_draw_is_bounded_and_never_empty(spark):
    """Rows of a language with very many are a small share; with repeated rows, and languages of few rows."""
    rows = [(i, f"text {i}", "en") for i in range(6000)] + [(7, "again", "en")] * 4000 + [(i, f"texte {i}", "fr") for i in range(3)] + [(None, None, "de")] * 5
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    for most in (1, 5, 4000):
        got = Counter(r["lang"] for r in L.drawn(df, most).collect())
        assert got == {"en": most, "fr": min(3, most), "de": 1}
    assert sorted(map(tuple, L.drawn(df, 5).collect()), key=str) == sorted(map(tuple, L.drawn(df.repartition(7), 5).collect()), key=str)
    assert L.bound_of(6000, 3000) == (1 << 63) - 1
    for n in (10**9, 10**12, 10**15):
        share = (L.bound_of(n, 3000) + (1 << 63)) / (1 << 64)
        assert share > 0 and abs(share * n - 6000) < 1


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the cat", "x", 0.5, True, 3)], "doc_id long, text string, lang_pred string, score double, held_out boolean, id long")
    model = L.Model(["en"], [tree_of(["the cat"])])
    got = L.predict(df, model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(1, "en")] and len(got[0]) == 3
