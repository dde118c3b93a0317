"""Queries of copy classes: leaks, conflicts and counts over all pairs of members."""

from pyspark.sql import functions as F

from corvane.operators import copies as C
from corvane.operators import splits as S
from corvane.operators.hashing import average_hash, hamming_pairs
from corvane.sources.tables import table


def _texts(spark, sf):
    """Documents by equal text; a bad quality label takes a row out of use, sources are groups, languages labels."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("grp"), F.col("lang").alias("label"), (F.col("doc_id") % 5).alias("fold"))
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    held = S.row_holdout(docs.join(bad, "doc_id", "left").withColumn("used", F.col("bad").isNull()).drop("bad"), "doc_id", 42, 0.2)
    return C.content_classes(held, "doc_id", F.sha2("text", 256)).drop("text")


def _vectors(spark, sf):
    """Vectors by equal 12-bit hashes of their first entries, with facts from entries that follow; links at one bit."""
    v = lambda k: F.get("embedding", k)
    rows = table(spark, sf, "embeddings").select(
        "vec_id", average_hash(F.slice("embedding", 1, 12)).alias("h"), F.col("label").alias("grp"), (v(13) > 0).cast("int").alias("label"), (v(14) > -0.1).alias("used"),
        F.when(v(15) > 0.1, "val").when(v(15) > -0.1, "train").alias("split"), F.floor(v(16) * 20).alias("fold"),
    )
    members = C.content_classes(rows, "vec_id", F.col("h").cast("string"))
    reps = members.where("vec_id = class_id").select("class_id", "h")
    return members, hamming_pairs(reps, "class_id", "h", 1)


def copy_pair_counts(spark, sf):
    """Counts over all pairs of copies, by class of equal text."""
    return C.pair_counts(_texts(spark, sf))


def copy_pair_counts_between_groups(spark, sf):
    return C.pair_counts(_texts(spark, sf), other_groups_only=True)


def leaking_copies(spark, sf):
    """Classes of equal texts of which some pair leaks, whichever members it is."""
    return C.leaking_classes(C.pair_counts(_texts(spark, sf))).select(F.col("a").alias("class_id"), "holdout", "kfold")


def copy_totals(spark, sf):
    members = _texts(spark, sf)
    return C.duplicate_totals(C.pair_counts(members), members)


def near_pair_counts(spark, sf):
    """Counts over all pairs of vectors of near hashes, by pair of classes."""
    return C.pair_counts(*_vectors(spark, sf))


def near_pair_counts_between_groups(spark, sf):
    return C.pair_counts(*_vectors(spark, sf), other_groups_only=True)


def near_totals(spark, sf):
    members, links = _vectors(spark, sf)
    return C.duplicate_totals(C.pair_counts(members, links, other_groups_only=True), members)


def group_conflicts_used(spark, sf):
    """Sources whose used rows fall into more than one split."""
    return S.overlapping_groups(_texts(spark, sf), "grp", "split", "used")


_TEXTS = (
    "texts as (select d.doc_id as key, min(d.doc_id) over (partition by coalesce(text, 'id ' || d.doc_id)) as class_id, source as grp, lang as label, b.doc_id is null as used, d.doc_id % 5 as fold,"
    " case when row_number() over (order by md5(concat_ws(':', '42', d.doc_id)), d.doc_id) - 1 >= count(*) over () - greatest(1, floor(count(*) over () * 0.2)) then 'val' else 'train' end as split"
    " from documents d left join (select distinct doc_id from labels where quality = 0) b on b.doc_id = d.doc_id)"
)
_BITS = "[(x > list_sum(embedding[1:12]::double[]) / 12)::int for x in embedding[1:12]::double[]]"
_VECTORS = (
    f"vectors as (select vec_id as key, bits, min(vec_id) over (partition by bits) as class_id, label as grp, (embedding[14] > 0)::int as label, embedding[15] > -0.1 as used, case when embedding[16]::double > 0.1 then 'val' when embedding[16]::double > -0.1 then 'train' end as split, floor(embedding[17] * 20)::bigint as fold"
    f" from (select *, {_BITS} as bits from embeddings))"
)


def _edges(members: str, near: str) -> str:
    """All pairs x, y with the classes they belong to; near: when two different classes are linked."""
    return f"pairs as (select least(x.class_id, y.class_id) as a, greatest(x.class_id, y.class_id) as b, x, y from {members} x join {members} y on x.key < y.key and (x.class_id = y.class_id or {near}))"


_SAME = "coalesce(x.grp = y.grp, false)"
_OUT = "coalesce(x.split <> y.split, false)"
_COUNTS = (
    f"select a, b, count(*) as pairs, count(*) filter ({_SAME}) as same_group, count(*) filter (x.label <> y.label) as conflicts, count(*) filter (x.used and y.used and not {_SAME} and {_OUT}) as holdout,"
    f" count(*) filter (x.used and y.used and not {_SAME} and not {_OUT} and coalesce(x.fold <> y.fold, false)) as kfold from pairs where {{where}} group by a, b"
)
_BITS_APART = "list_sum(list_transform(range(1, 13), lambda i: abs(x.bits[i] - y.bits[i]))) = 1"
_OF_TEXTS = f"with recursive {_TEXTS}, {_edges('texts', 'false')}"
_OF_VECTORS = f"with recursive {_VECTORS}, {_edges('vectors', _BITS_APART)}"


def _totals(members: str, where: str) -> str:
    return (
        f", held as (select * from pairs where {where}), ends as (select x.key as k, y.key as l from held union select y.key, x.key from held),"
        " reach as (select k, k as l from ends union select r.k, e.l from reach r join ends e on r.l = e.k), roots as (select k, min(l) as root from reach group by k)"
        f" select (select count(*) from held) as confirmed_pairs, (select count(distinct root) from roots) as groups, (select count(*) from roots) as images_in_groups, (select count(*) from held where x.label <> y.label) as label_conflict_pairs,"
        f" (select count(distinct root) from held join roots on k = x.key where x.label <> y.label) as conflict_groups, (select count(*) from held where x.used and y.used and not {_SAME} and ({_OUT} or coalesce(x.fold <> y.fold, false))) as split_leak_pairs"
    )


SQL = {
    "copy_pair_counts": f"{_OF_TEXTS} {_COUNTS.format(where='true')}",
    "copy_pair_counts_between_groups": f"{_OF_TEXTS} {_COUNTS.format(where='not ' + _SAME)}",
    "leaking_copies": f"{_OF_TEXTS} select a as class_id, holdout, kfold from ({_COUNTS.format(where='true')}) where holdout + kfold > 0",
    "copy_totals": f"{_OF_TEXTS}{_totals('texts', 'true')}",
    "near_pair_counts": f"{_OF_VECTORS} {_COUNTS.format(where='true')}",
    "near_pair_counts_between_groups": f"{_OF_VECTORS} {_COUNTS.format(where='not ' + _SAME)}",
    "near_totals": f"{_OF_VECTORS}{_totals('vectors', 'not ' + _SAME)}",
    "group_conflicts_used": f"with {_TEXTS} select grp, count(distinct split) as splits from texts where used and grp is not null group by grp having count(distinct split) > 1",
}
QUERIES = {f.__name__: f for f in (copy_pair_counts, copy_pair_counts_between_groups, leaking_copies, copy_totals, near_pair_counts, near_pair_counts_between_groups, near_totals, group_conflicts_used)}
