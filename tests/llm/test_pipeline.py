import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from gridloom.llm import jaccard_join, language_id, packing, pii, queries, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    return {tuple(r) for r in C.run(spark, SF).collect()}


def test_stages_are_those_named():
    assert [n for n, _ in C.STAGES] == ["toxicity", "jaccard join", "suffix-array dedup", "pii", "packing"] and C.ORACLE_SQL is None


def test_equals_the_stages_done_plainly(spark, result):
    """The same decisions from the operators' own functions, text by text."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(toxicity.label_rows(frame, spark.read.parquet(f"{SF}/labels.parquet")))
    docs = [d for d, s in zip(docs, toxicity.score_texts([t or "" for _, t in docs], model), strict=True) if s < 0.5]
    # near-duplicates by comparing every pair
    sets = [set(jaccard_join.shingles(t).tolist()) for _, t in docs]
    parent = list(range(len(docs)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    docs = sorted(d for i, d in enumerate(docs) if d[0] == least[root(i)])
    # repeated windows by a dictionary of all of them
    seen = {}
    for _, t in docs:
        raw = t.encode()
        for i in range(len(raw) - 199):
            seen[raw[i : i + 200]] = seen.get(raw[i : i + 200], 0) + 1
    texts = []
    for doc, t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        cover = np.cumsum(gone)[: len(raw)] > 0
        texts.append((doc, bytes(np.frombuffer(raw, np.uint8)[~cover]).decode("utf-8", "ignore") if len(raw) else ""))
    tokens = packing.Tokenization(packing.public_tokenization().json_path)
    want = set()
    for doc, t in texts:
        ids = np.array([*tokens.ids(pii.redacted(t)), 0], "<u4")
        want |= {(doc, a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)}
    assert {r[:5] for r in result} == want


def test_queries_return_whole_tables(spark):
    found, n = queries.queries(), {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    assert list(found) == sorted(found, key=lambda k: int(k[2:].split("_")[0]))
    assert set(queries.oracle_sql()) <= set(found)
    for name, f in found.items():
        got = f(spark, SF).count()
        if name.startswith("op1_"):
            assert got == 20 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
        elif name.startswith("op2_"):
            assert got >= n["documents"]
        else:
            assert got == n["pages" if name.startswith("op5_") else "documents"]


def test_prediction_inputs(spark):
    """lang, source and id say nothing about a text's predicted language."""
    df = spark.createDataFrame([(1, "la table et le chat"), (2, "la table et le chat")], "doc_id long, text string")
    model = language_id.train(df.selectExpr("doc_id id", "text", "'fr' lang"))
    assert {tuple(r)[1:] for r in language_id.predict(df, model).collect()} == {("fr", 1.0)}
    assert suffix_dedup.DEPTH == 200


def odd_tables(spark, folder, docs, columns):
    spark.createDataFrame(docs, columns).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k % 5 == 1)) for k in range(1000, 1060)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_tables(spark, tmp_path):
    """Null, empty and very long texts, null and repeated ids, and columns whose names the operators use themselves."""
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    long, same, shared = text(60_000), text(80), text(60)
    rows = [(1, None), (2, ""), (3, long), (4, same), (4, same), (4, text(50)), (None, same), (None, None), (5, f"{text(30)} {shared} {text(30)}"), (6, f"{text(30)} {shared} {text(30)}")]
    rows += [(k, f"{'stupid moron ' * 3 if k % 5 == 1 else 'kind friend '} {text(10)}") for k in range(1000, 1060)]
    docs = [(d, t, 7, f"x{i}", float(i), i) for i, (d, t) in enumerate(rows)]
    folder = odd_tables(spark, tmp_path, docs, "doc_id long, text string, _row int, bands string, score double, rank int")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept = C.drop_near_duplicates(spark, frame, folder)
    assert kept.columns == frame.columns and kept.count() == len(rows) - 1  # of the two rows 4 with one text, one stays
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns, name
        assert stage(spark, frame.limit(0), folder).count() == 0, name
    got = C.run(spark, folder).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r["doc_id"], []).append(r["doc_tokens"])
    assert tokens[1] == [1] and tokens[2] == [1] and len(tokens[4]) == 2 and len(tokens[3]) > 100
    assert len(tokens[None]) == 2 and max(tokens[5] + tokens[6]) < 700
    assert not any(k in tokens for k in range(1000, 1060) if k % 5 == 1 and zlib.crc32(str(k).encode()) % 5)
