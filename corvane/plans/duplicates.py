"""Queries of copies, duplicate groups, leakage and hashes."""

from pyspark.sql import functions as F

from corvane.operators import copies as C
from corvane.operators import graph as G
from corvane.operators import hashing as H
from corvane.operators import splits as S
from corvane.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _grouped(spark, sf):
    docs = _docs(spark, sf)
    return G.attach_groups(docs.select("doc_id", "source", "lang"), "doc_id", G.copy_pairs(docs, "doc_id", "text"), "first", "key")


def leak_exact_copies(spark, sf):
    """Every document with its class of equal texts, its side of the hold-out of sources, and how many copies it has, in all and on the other side."""
    facts = S.group_holdout(_docs(spark, sf).select("doc_id", "text", F.col("source").alias("grp")), "grp", 42, 0.2)
    return C.member_leaks(C.content_classes(facts, "doc_id", F.sha2("text", 256)), "doc_id")


def dup_groups_text(spark, sf):
    return _grouped(spark, sf).select("doc_id", "dup_group")


def dup_group_summary(spark, sf):
    """One row: groups of two or more, documents in them, groups with more than one language."""
    groups = _grouped(spark, sf).groupBy("dup_group").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count_if(F.col("langs") > 1).alias("conflicts"))


def dup_resolved_subset(spark, sf):
    return G.resolved_subset(_grouped(spark, sf), "doc_id", "dup_group", "lang").select("doc_id", "dup_group")


def _hashes(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", H.average_hash(F.col("embedding")).alias("ahash"), H.difference_hash(F.col("embedding"), 7).alias("dhash"))


def image_hashes(spark, sf):
    return _hashes(spark, sf)


def hamming_near(spark, sf):
    return H.hamming_pairs(_hashes(spark, sf), "vec_id", "ahash", 17)


def cross_source_near(spark, sf):
    """Near hashes between images of different labels."""
    rows = _hashes(spark, sf)
    near = H.hamming_pairs(rows, "vec_id", "ahash", 17)
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("label").alias("label_a")), rows.select(F.col("vec_id").alias("b"), F.col("label").alias("label_b"))
    return near.join(a, "a").join(b, "b").where("label_a <> label_b").select("a", "b", "label_a", "label_b", "distance")


_SPLIT = "select source, case when r >= n - greatest(1, floor(n * 0.2)) then 'val' else 'train' end as split from (select source, row_number() over (order by md5(concat_ws(':', '42', source)), source) - 1 as r, count(*) over () as n from (select distinct source from documents))"
_GROUP = "select doc_id, source, lang, min(doc_id) over (partition by text) as dup_group from documents"
_BITS = "select vec_id, label, embedding, list_avg([x::double for x in embedding]) as m from embeddings"
_PACK = "list_reduce(list_prepend(0::hugeint, [({})::int::hugeint for i in range(1, 65)]), lambda a, b: a * 2 + b)"
_A = _PACK.format("embedding[i]::double > m")
_D = "list_reduce(list_prepend(0::hugeint, [(embedding[i] < embedding[i + 1])::int::hugeint for i in range(1, 64) if i % 8 <> 0]), lambda a, b: a * 2 + b)"
_SIGNED = "cast(case when {0} >= 9223372036854775808::hugeint then {0} - 18446744073709551616::hugeint else {0} end as bigint)"
_HASH = f"select vec_id, label, {_SIGNED.format('a')} as ahash, {_SIGNED.format('d')} as dhash from (select vec_id, label, {_A} as a, {_D} as d from ({_BITS}))"
_NEAR = f"with h as ({_HASH}) select x.vec_id as a, y.vec_id as b, x.label as label_a, y.label as label_b, cast(bit_count(xor(x.ahash, y.ahash)) as integer) as distance from h x join h y on x.vec_id < y.vec_id and bit_count(xor(x.ahash, y.ahash)) <= 17"

SQL = {
    "leak_exact_copies": (
        f"with g as (select doc_id, source, case when text is null then doc_id else min(doc_id) over (partition by text) end as class_id from documents), s as ({_SPLIT}), m as (select doc_id, class_id, split from g join s on s.source is not distinct from g.source)"
        " select doc_id, class_id, split, count(*) over (partition by class_id) - 1 as copies, count(*) over (partition by class_id) - count(*) over (partition by class_id, split) as leaks from m"
    ),
    "dup_groups_text": f"select doc_id, dup_group from ({_GROUP})",
    "dup_group_summary": f"select count(*) as groups, cast(coalesce(sum(n), 0) as bigint) as documents, count(*) filter (langs > 1) as conflicts from (select dup_group, count(*) n, count(distinct lang) langs from ({_GROUP}) group by 1 having count(*) > 1)",
    "dup_resolved_subset": f"select min(doc_id) as doc_id, dup_group from ({_GROUP}) group by dup_group having count(distinct lang) <= 1",
    "image_hashes": _HASH,
    "hamming_near": f"select a, b, distance from ({_NEAR})",
    "cross_source_near": f"select * from ({_NEAR}) where label_a <> label_b",
}
QUERIES = {f.__name__: f for f in (leak_exact_copies, dup_groups_text, dup_group_summary, dup_resolved_subset, image_hashes, hamming_near, cross_source_near)}
