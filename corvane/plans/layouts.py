"""Queries of what catalogues of different layouts need: casts, slots, boxes, labels, keys and levels, each with SQL of its own."""

from pyspark.sql import functions as F

from corvane.functions import projections as R
from corvane.operators import levels as V
from corvane.operators import pixels as P
from corvane.operators import series
from corvane.sources import adapters as A
from corvane.sources.tables import table


def checked_casts(spark, sf):
    """Two texts as numbers; what is none is told, and stops nothing."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_custkey").cast("string")).alias("code"))
    return R.checked_cast(R.checked_cast(c, "segment", "int"), "code", "int")


def merged_users(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"))
    return e.select("event_id", R.merged_ids(F.col("u"), {"u1": "u2", "u2": "u3", "u7": "u1"}).alias("u"))


def branch_slots(spark, sf):
    e = table(spark, sf, "embeddings")
    slots, there = R.one_slot(F.col("label") % 3, F.col("vec_id"), 3)
    return e.select("vec_id", F.array_join(F.transform(slots, lambda s: s.cast("string")), ",", "-").alias("slots"), F.array_join(F.transform(there, lambda t: t.cast("string")), ",").alias("there"))


def line_slices(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.lit(2).alias("lo"), F.col("l_linenumber").alias("hi"))
    return R.slices_of(li, "l_orderkey", "lo", "hi").select("l_orderkey", "l_partkey", "l_linenumber", "slice")


def complete_orders(spark, sf):
    return R.complete_cases(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N"])


def labels_in_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.label_in_name(F.lower("p_type"), {"brass": 1, "steel": 0, "tin": 2}).alias("label"))


def text_boxes(spark, sf):
    """Boxes from lists written as text; a list of three numbers is no box."""
    p = table(spark, sf, "part")
    text = F.concat(F.lit("["), F.col("p_size"), F.lit(", 7, "), F.col("p_size") * 2, F.when(F.col("p_partkey") % 4 == 0, F.lit("]")).otherwise(F.lit(", 9]")))
    return p.select("p_partkey", A.box_of_list(text).alias("b")).select("p_partkey", "b.x0", "b.y0", "b.x1", "b.y1")


def circle_boxes(spark, sf):
    """The box around all circles of an order, counted from the bottom of an image of 1024 lines."""
    li = table(spark, sf, "lineitem")
    box = A.box_of_circle((F.col("l_partkey") % 500).cast("int"), (F.col("l_suppkey") % 300).cast("int"), F.col("l_linenumber"), 1024)
    return A.box_around(li.select("l_orderkey", box.alias("box")), ["l_orderkey"], "box").select("l_orderkey", "box.x0", "box.y0", "box.x1", "box.y1")


def line_labels(spark, sf):
    """The first line with a known mark labels an order."""
    li = table(spark, sf, "lineitem").withColumn("at", F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey"))
    return A.label_by_lines(li, "l_orderkey", "at", "l_returnflag", {"R": 1, "A": 0}, None, "l_linestatus")


def part_folders(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("path"), "l_extendedprice")
    return A.smallest_and_largest(li, "l_suppkey", F.col("l_extendedprice"), "path")


def positive_orders(spark, sf):
    return A.any_positive(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R").withColumn("malignant", F.col("malignant").cast("int"))


def parsed_keys(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "@x@y").otherwise("")).alias("key"))
    return e.select("event_id", A.parsed_key(F.col("key")).alias("key"))


def tidied_codes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, " IMG").otherwise("pic"), F.col("o_orderkey").cast("string")).alias("image"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("code"))
    return A.tidy_codes(o, "image", "code", {"1-URGENT": "NOW", "5-LOW": "LATER"})


def peak_lines(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("area"))
    return A.peak_rows(li, ["l_orderkey"], "area", "l_linenumber")


def recoded_labels(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", A.recoded(F.col("label"), {1: 0, 2: 1}).alias("label"))


def first_orders(spark, sf):
    """The first order of each of the twenty first customers."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return series.first_per_group(o, "o_custkey", ["o_orderkey"], 20)


def _levels(spark, sf):
    return P.levels_of(P.grid(table(spark, sf, "embeddings"), "vec_id", F.col("embedding"), 8), -1.0, 1.0, 256)


def equalised_levels(spark, sf):
    return V.equalised(_levels(spark, sf), "image", "level", "n").select(F.col("image").alias("vec_id"), "level", "mapped")


def windowed_levels(spark, sf):
    return V.windowed(_levels(spark, sf), "image", "level", "n", 0.25, 0.75).select(F.col("image").alias("vec_id"), "level", "mapped")


_LEVELS = "levels as (select vec_id, greatest(least(floor((v::double + 1) / (2.0::double / 256)), 255), 0)::int as level, count(*) as n from (select vec_id, unnest(embedding) as v from embeddings) group by all)"
SQL = {
    "checked_casts": "select c_custkey, try_cast(segment as int) as segment, try_cast(code as int) as code, nullif(concat_ws('; ', case when try_cast(segment as int) is null then 'segment: no int: ' || segment end, case when try_cast(code as int) is null then 'code: no int: ' || code end), '') as load_error from (select c_custkey, c_mktsegment as segment, case when c_custkey % 3 = 0 then 'n/a' else c_custkey::varchar end as code from customer)",
    "merged_users": "select event_id, case u when 'u1' then 'u2' when 'u2' then 'u3' when 'u7' then 'u1' else u end as u from (select event_id, 'u' || user_id as u from events)",
    "branch_slots": "select vec_id, array_to_string([case when label % 3 = k then vec_id::varchar else '-' end for k in range(0, 3)], ',') as slots, array_to_string([(label % 3 = k)::varchar for k in range(0, 3)], ',') as there from embeddings",
    "line_slices": "select l_orderkey, l_partkey, l_linenumber, unnest(range(2, l_linenumber + 1))::int as slice from lineitem",
    "complete_orders": "select l_orderkey from lineitem where l_returnflag in ('A', 'N') group by l_orderkey having count(distinct l_returnflag) = 2",
    "labels_in_names": "select p_partkey, case when lower(p_type) like '%brass%' then 1 when lower(p_type) like '%steel%' then 0 when lower(p_type) like '%tin%' then 2 end as label from part",
    "text_boxes": "select p_partkey, case when p_partkey % 4 <> 0 then p_size::int end as x0, case when p_partkey % 4 <> 0 then 7 end as y0, case when p_partkey % 4 <> 0 then (3 * p_size)::int end as x1, case when p_partkey % 4 <> 0 then 16 end as y1 from part",
    "circle_boxes": "select l_orderkey, min(l_partkey % 500 - l_linenumber)::int as x0, min(1024 - l_suppkey % 300 - l_linenumber)::int as y0, max(l_partkey % 500 + l_linenumber)::int as x1, max(1024 - l_suppkey % 300 + l_linenumber)::int as y1 from lineitem group by l_orderkey",
    "line_labels": "select l_orderkey, arg_min(case l_returnflag when 'R' then 1 when 'A' then 0 end, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) filter (l_returnflag in ('R', 'A')) as label, string_agg(distinct l_linestatus, '|' order by l_linestatus) as findings from lineitem group by l_orderkey",
    "part_folders": "with f as (select l_suppkey, concat_ws('/', l_orderkey, l_linenumber, l_partkey) as path, l_extendedprice as size from lineitem) select l_suppkey, arg_min(path, (size, path)) as smallest, case when count(*) > 1 then arg_max(path, (size, path)) end as largest from f group by l_suppkey",
    "positive_orders": "select l_orderkey, max((l_returnflag = 'R')::int) as malignant, count(*) as n from lineitem group by l_orderkey",
    "parsed_keys": "select event_id, case when strpos(event_type, '_') = 0 then user_id::varchar else split_part(substr(event_type || '_' || user_id, strpos(event_type, '_') + 1), '@', 1) end as key from events",
    "tidied_codes": "select o_orderkey, 'IMG' || o_orderkey as image, case upper(o_orderpriority) when '1-URGENT' then 'NOW' when '5-LOW' then 'LATER' else upper(o_orderpriority) end as code from orders where o_orderkey % 3 = 0",
    "peak_lines": "with m as (select l_orderkey, l_linenumber, max(l_quantity) as area from lineitem group by all) select l_orderkey, l_linenumber, area from (select *, row_number() over (partition by l_orderkey order by area desc, l_linenumber) as r from m) where r = 1",
    "recoded_labels": "select vec_id, case label when 1 then 0 when 2 then 1 end as label from embeddings",
    "first_orders": "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r = 1 order by o_custkey limit 20",
    "equalised_levels": f"with {_LEVELS}, c as (select vec_id, level, sum(n) over (partition by vec_id order by level) / 64.0::double as cdf from levels), f as (select *, min(cdf) over (partition by vec_id) as a from c) select vec_id, level, coalesce(round_even((cdf - a) / nullif(1 - a, 0) * 255, 0), level)::int as mapped from f",
    "windowed_levels": f"with {_LEVELS}, e as (select vec_id, quantile_cont(level::double, 0.25) as a, quantile_cont(level::double, 0.75) as b from (select vec_id, level, unnest(range(0, n)) from levels) group by vec_id) select l.vec_id, level, case when b > a then round_even(least(greatest((level - a) / (b - a), 0), 1) * 255, 0) else level end::int as mapped from levels l join e on l.vec_id = e.vec_id",
}
QUERIES = {
    f.__name__: f
    for f in (
        checked_casts, merged_users, branch_slots, line_slices, complete_orders, labels_in_names, text_boxes, circle_boxes, line_labels, part_folders, positive_orders, parsed_keys, tidied_codes, peak_lines, recoded_labels,
        first_orders, equalised_levels, windowed_levels,
    )
}
