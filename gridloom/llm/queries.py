"""The contract queries opN_<name>. Each is a thin reading of its operator's real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, language_id, media, packing, partition_ann, piece_model, pii, suffix_dedup, toxicity, warc
from .common import load, materialise


def op1_partition_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return partition_ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), packing.public_tokenization())


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.tensors(media.store(load(spark, sf_dir, "documents")), with_tensors=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc.archive(load(spark, sf_dir, "pages"))
    got = warc.read(spark, manifest, folder, with_payload=False)
    digests = materialise(got.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"), "read")
    warc.remove(manifest, folder)
    return digests


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.train(docs.where(~held).select(F.col("doc_id").alias("id"), "text", "lang"))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(load(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_model.digests(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.label_rows(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_partition_ann": op1_partition_ann,
        "op2_packing": op2_packing,
        "op3_media": op3_media,
        "op4_pii": op4_pii,
        "op5_warc": op5_warc,
        "op6_language_id": op6_language_id,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_pieces": op8_pieces,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": """
with p as (select page_id, coalesce(html, '') html from pages),
k as (select html, max(page_id) keep from p where strlen(html) >= 1000 group by html having count(*) > 1)
select page_id, cast(strlen(p.html) as bigint) payload_bytes, sha1(p.html) payload_digest,
  case when keep is not null and page_id is distinct from keep then 'revisit' else 'response' end record_type,
  case when page_id is distinct from keep then keep end refers_to
from p left join k on p.html = k.html""",
        "op7_jaccard_join": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') ws from documents where text is not null),
s as (select distinct doc_id, unnest(case when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) g from w where len(ws) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
e as materialized (select a, b from l union all select b, a from l),
r as (select a doc_id, a other from e union select r.doc_id, e.b from r join e on e.a = r.other)
select d.doc_id, coalesce((select min(other) from r where r.doc_id = d.doc_id), d.doc_id) class_id,
  (select count(*) from e where e.a = d.doc_id) n_links from documents d""",
        "op9_suffix_dedup": """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
win as materialized (select doc_id, i, md5_number(substring(h, 2 * i + 1, 400)) k from (select doc_id, h, unnest(range(0, n - 199)) i from d)),
st as (select doc_id, i from win where k in (select k from win group by k having count(*) > 1)),
marked as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end fresh from st),
island as (select *, sum(fresh) over (partition by doc_id order by i) g from marked),
gone as (select doc_id, min(i) a, max(i) + 200 b from island group by doc_id, g),
cut as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) f, a t from gone
  union all select doc_id, max(b), max(n) from gone join d using (doc_id) group by 1),
kept as (select doc_id, string_agg(substring(h, 2 * f + 1, 2 * (t - f)), '' order by f) k from cut join d using (doc_id) group by 1)
select doc_id, cast(n as bigint) n_bytes, cast(coalesce(sum(b - a), 0) as bigint) n_removed, count(a) n_spans,
  sha256(unhex(coalesce(any_value(k), any_value(h)))) kept_sha256
from d left join gone using (doc_id) left join kept using (doc_id) group by doc_id, n""",
    }
