import hashlib
import struct

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from gridloom.llm import piece_model as M

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def samples():
    rng = np.random.default_rng(9)
    alphabet = ["a", "the ", " ", "  ", "\n", "é", "ß", "日", "😀", "▁", "\0", "\t", ".", "Ω", "́", "𝔘", "word", "<s>", "<0x41>", "ไ", "x y"]
    out = ["", " ", "   ", "\n", "▁", " ▁ ", "a" * 5000, "end  "]
    return out + ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(800)]


def test_ids_and_text_equal_the_library(library):
    texts = samples()
    model = M.model_at(PATH)
    assert model.by_word
    for t, got in zip(texts, model.encode_all(texts), strict=True):
        ids = library.encode(t)
        assert list(got.ids) == ids, repr(t)
        assert got.decoded == model.decode(ids) == library.decode(ids), repr(t)
        assert got.ids_text == ",".join(map(str, ids))


def test_ranges_cover_the_text(library):
    texts = samples()
    for t, got in zip(texts, M.model_at(PATH).encode_all(texts), strict=True):
        raw = t.encode()
        want = [p.surface for p in library.encode(t, return_type="proto").pieces]
        mine = [raw[b:e].decode() for b, e in zip(got.begin, got.end, strict=True)]
        assert mine == want, repr(t)
        assert "".join(mine) == t


def test_decoding_bytes(library):
    rng = np.random.default_rng(10)
    for _ in range(500):
        ids = [int(i) for i in rng.choice([*range(3, 259), 259, 264, 28705, 1, 2, 0], rng.integers(1, 8))]
        assert M.model_at(PATH).decode(ids) == library.decode(ids), ids


def double_array(pairs):
    """A compiled map of a few prefixes, laid out by hand: (prefix, replacement) pairs."""
    strings, value = b"", {}
    for k, v in pairs:
        value[k], strings = len(strings), strings + v + b"\0"
    units, used, bases = [0] * 1024, {0}, set()

    def place(node, prefix):
        kids = sorted({k[len(prefix)] for k in value if k.startswith(prefix) and len(k) > len(prefix)})
        labels = ([0] if prefix in value else []) + kids
        base = next(b for b in range(1, 1024) if b not in bases and all((b ^ c) not in used and (b ^ c) < 1024 for c in labels) and (node ^ b) < 1 << 21)
        bases.add(base)
        used.update(base ^ c for c in labels)
        units[node] |= (node ^ base) << 10 | ((prefix in value) << 8)
        if prefix in value:
            units[base] = value[prefix] | 1 << 31
        for c in kids:
            units[base ^ c] = c
        for c in kids:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    blob = struct.pack("<1024I", *units)
    return struct.pack("<I", len(blob)) + blob + strings


def test_longest_prefix_and_alignment():
    m = M.PieceModel(open(PATH, "rb").read())
    m.map = M.CharacterMap(double_array([(b"a", b"A"), (b"abc", b"xy"), ("é".encode(), b"e"), (b"\t", b" "), (b"q", b"")]))
    text = "abab\tcabcéq!"
    shown, align = m.normalise(text)
    assert shown == "▁AbAb▁cxye!"
    raw = text.encode()
    assert len(align) == len(shown.encode()) + 1 and list(align) == sorted(align) and align[-1] == len(raw)
    got = m.encode_all([text])[0]
    assert got.begin[0] == 0 and got.end[-1] == len(raw)
    m.squeeze = True
    assert m.normalise("  a \t b  ")[0] == "▁A▁b"


def test_rows(spark):
    df = spark.createDataFrame([(1, "a cat", "z"), (1, "a cat", "z"), (2, None, None), (None, "", "")], "doc_id long, text string, ids string")
    enc = M.encode(df, PATH)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in M.decode(enc, PATH).collect()) == [(0, ""), (1, "a cat"), (1, "a cat"), (2, "")]
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"]) for r in M.digests(df, PATH).where("doc_id = 2").collect()} == {(0, empty)}
    assert M.digests(df.limit(0), PATH).count() == 0
