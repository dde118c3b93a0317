"""Queries of catalogues."""

from corvane.sources.catalogue import Spec, build_catalogue, union_catalogues
from corvane.sources.tables import table

SPECS = {
    "orders": Spec("orders", "o_orderkey", "o_custkey", "o_orderstatus", {"f": 1, "o": 0}, split="case when o_orderkey % 5 = 0 then 'test' else 'train' end"),
    "lineitem": Spec("lineitem", "l_orderkey", "l_suppkey", "l_returnflag", {"r": 1, "a": 0}, keep="l_quantity > 5", once=("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")),
    "part": Spec("part", "p_partkey", "p_brand", "case when p_size > 40 then ' Malignant' when p_size < 10 then 'BENIGN ' end", {"malignant": 1, "benign": 0}),
}


def catalogue_union(spark, sf):
    return union_catalogues([build_catalogue(table(spark, sf, name), spec) for name, spec in SPECS.items()])


def catalogue_counts(spark, sf):
    return catalogue_union(spark, sf).groupBy("dataset", "label").count().withColumnRenamed("count", "n")


_ALL = """
select cast(o_orderkey as varchar) as sample_id, 'orders' as dataset, cast(o_custkey as varchar) as grp, o_orderstatus as label_name,
    case o_orderstatus when 'F' then 1 when 'O' then 0 end as label, o_orderstatus in ('F', 'O') as used, case when o_orderkey % 5 = 0 then 'test' else 'train' end as split from orders
union all select cast(l_orderkey as varchar), 'lineitem', cast(l_suppkey as varchar), l_returnflag, case l_returnflag when 'R' then 1 when 'A' then 0 end, l_returnflag in ('R', 'A'), null
    from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as rn from lineitem where l_quantity > 5) where rn = 1
union all select cast(p_partkey as varchar), 'part', p_brand, case when p_size > 40 then ' Malignant' when p_size < 10 then 'BENIGN ' end, case when p_size > 40 then 1 when p_size < 10 then 0 end, p_size > 40 or p_size < 10, null from part
"""
SQL = {"catalogue_union": _ALL, "catalogue_counts": f"select dataset, label, count(*) as n from ({_ALL}) group by 1, 2"}
QUERIES = {f.__name__: f for f in (catalogue_union, catalogue_counts)}
