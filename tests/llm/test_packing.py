import zlib

import numpy as np
import pytest

from gridloom.llm import packing


@pytest.fixture(scope="module")
def tokens():
    return packing.public_tokenization()


def test_fast_ids_equal_the_defining_ones(tokens):
    import os

    exact = packing.Tokenization(tokens.json_path)
    rng = np.random.default_rng(1)
    alphabet = list("abc XYZ019.,'\n\t  éßñçü°½²ŒÿĀſ \u0085­-_@%") + ["'s", "'re", " the", "日本", " ", "😀", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert tokens.ids(text) == exact.ids(text), repr(text)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(2)
    for size in (0, 1, 30, 5000):
        lengths = rng.integers(1, 1025, size)
        hist = np.bincount(lengths, minlength=1025)
        plan = packing.solve(hist)
        used = np.zeros(1025, int)
        for combo, n in plan:
            assert n > 0 and sum(combo) <= 1024
            for l in combo:
                used[l] += n
        assert (used == hist).all()
        if size == 5000:
            total = sum(n for _, n in plan) * 1024
            assert hist @ np.arange(1025) / total > 0.97


def test_pack(spark, tokens):
    long = "the cat sat on a mat. " * 3000
    rows = [(i, t, "x") for i, t in enumerate([long, "", None, "a", "a", *["hello world " * (k % 90) for k in range(300)]])] + [(7, "same", "x"), (7, "same", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = packing.pack(df, tokens).toPandas()
    want = {}
    for doc, text, _ in rows:
        ids = np.array([*packing.Tokenization(tokens.json_path).ids(text or ""), 0], "<u4")
        want.setdefault(-1 if doc is None else doc, []).append(ids)
    assert got["length"].sum() == sum(len(i) for v in want.values() for i in v)
    for doc, part in got.assign(doc_id=got["doc_id"].fillna(-1)).groupby("doc_id"):
        if len(want[doc]) == 1:
            ids = want[doc][0]
            part = part.sort_values("start")
            assert list(part["start"]) == [0, *np.cumsum(part["length"])[:-1]] and (part["doc_tokens"] == len(ids)).all()
            assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part["start"], part["length"])] == list(part["ids_crc32"])
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq["offset"]) == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 1024
    assert packing.pack(df.limit(0), tokens).count() == 0


def test_every_plain_character_is_split_alike(tokens):
    exact = packing.Tokenization(tokens.json_path)
    for c in map(chr, range(packing.PLAIN + 1)):
        for text in (f"a{c}b", f" {c}{c} 1{c}", f"{c}'s {c}\n", f"x  {c}  y", c, f"{c}  "):
            assert tokens.ids(text) == exact.ids(text), repr(text)
