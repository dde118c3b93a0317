"""DuckDB SQL of the queries in tabular and pixels; {table} stands for a table of the folder."""

from __future__ import annotations

import re

PX = "(select vec_id, label, unnest(range(0, 64)) as i, unnest(embedding) as v from embeddings)"
GRID = "(select vec_id, label, i, cast(floor(i / 8) as int) as y, i % 8 as x, cast(v as double) as v from {px})"

TEXT = {
    # catalogue and report summaries
    "catalogue_summary": "select source, count(*) as n, count(distinct lang) as langs, sum(case when l.doc_id is null then 0 else 1 end) as labelled, sum(coalesce(quality, 0)) as good, min(n_chars) as min_chars, max(n_chars) as max_chars, round(avg(n_chars), 6) as mean_chars from {documents} d left join {labels} l on d.doc_id = l.doc_id group by source",
    "claimed_vs_verified": "select c.source, c.claimed, coalesce(o.n, 0) as observed, coalesce(o.n, 0) - c.claimed as difference from (select distinct source, 50 as claimed from {documents}) c left join (select source, count(*) as n from {documents} group by source) o on c.source = o.source",
    "group_split_conflicts": "select o_custkey, count(distinct o_orderstatus) as splits from {orders} group by o_custkey having count(distinct o_orderstatus) > 1",
    "images_per_group": "select min(n) as least, median(n) as mid, max(n) as most, count(*) as grps from (select o_custkey, count(*) as n from {orders} group by o_custkey) t",
    "centre_pivot": "select source, sum(case when quality = 0 then 1 else 0 end) as bad, sum(case when quality = 1 then 1 else 0 end) as good, round(sum(case when quality = 0 then 1 else 0 end) / nullif(cast(count(*) as double), 0), 3) as bad_share, median(n_chars) as median_chars from {documents} d join {labels} l on d.doc_id = l.doc_id group by source",
    "report_quality": "select event_type, count(*) as n, round(percentile_cont(0.25) within group (order by value), 6) as q25, round(percentile_cont(0.5) within group (order by value), 6) as q50, round(percentile_cont(0.75) within group (order by value), 6) as q75 from {events} group by event_type",
    "manifest_rollup": "select l_returnflag, l_linestatus, count(*) as items, sum(l_quantity) as slices, count(distinct l_orderkey) as orders_n from {lineitem} group by rollup (l_returnflag, l_linestatus)",
    "macro_facts": "select 'orders' as name, cast(count(*) as double) as value from {orders} union all select 'share_large', round(avg(case when o_totalprice > 200000 then 1.0 else 0.0 end), 9) from {orders} union all select 'max_total', cast(max(o_totalprice) as double) from {orders}",
    "slice_patient_rollup": "select o_custkey, round(max(lesion), 6) as max_score, max(label) as label from (select o_custkey, o_orderkey, avg(l_discount) as lesion, max(case when l_returnflag = 'R' then 1 else 0 end) as label from {orders} join {lineitem} on o_orderkey = l_orderkey group by o_custkey, o_orderkey) t group by o_custkey",
    "class_rate_per_group": "select count(*) as grps, sum(label) as positive, round(avg(cast(label as double)), 9) as rate from (select o_custkey, max(case when o_orderstatus = 'F' then 1 else 0 end) as label from {orders} group by o_custkey) t",
    "flag_rates": "select event_type, round(100 * avg(case when coalesce(value > 100, false) then 1.0 else 0.0 end), 6) as over_100, round(100 * avg(case when value < 10 then 1.0 else 0.0 end), 6) as under_10 from {events} group by event_type",
    "size_totals": "select source, case when count(n_chars) = count(*) then sum(n_chars) end as total, count(*) as files from {documents} group by source",
    "hist_by_label": "select quality, cast(floor(n_chars / 500) as int) as bin, count(*) as n from {documents} d join {labels} l on d.doc_id = l.doc_id group by quality, cast(floor(n_chars / 500) as int)",
    "split_code_mode": "select split_code, n, case when rk = 1 then 'train' else 'other' end as split from (select o_orderpriority as split_code, count(*) as n, row_number() over (order by count(*) desc, o_orderpriority) as rk from {orders} group by o_orderpriority) t",
    "pooled_mean": "select round(sum(s) / sum(n), 9) as mean_value from (select user_id, sum(value) as s, count(*) as n from {events} group by user_id) t",
    # projections and joins
    "onehot_label": "select c_custkey, coalesce(case when c_mktsegment = 'BUILDING' then 'building' end, case when c_acctbal < 0 then 'debt' end, case when c_acctbal > 5000 then 'rich' end, 'normal') as label from {customer}",
    "composite_key_first": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_orderkey, l_partkey, l_suppkey order by l_linenumber, l_quantity) as rn from {lineitem}) t where rn = 1",
    "composite_key_last": "select o_orderkey, l_suppkey, l_quantity from {orders} join (select l_orderkey, l_suppkey, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey, l_suppkey, l_quantity) as rn from {lineitem}) t on o_orderkey = l_orderkey where rn = 1",
    "keep_first_per_key": "select event_id, user_id, value from (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) as rn from {events}) t where rn = 1",
    "latest_state": "select user_id, event_id, event_type from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from {events}) t where rn = 1",
    "endpoint_union": "select l_partkey as endpoint from {lineitem} union select l_suppkey from {lineitem}",
    "exclusion_list": "select d.doc_id, d.source from {documents} d left anti join (select doc_id from {labels} where toxic = 1) x on d.doc_id = x.doc_id",
    "label_lookup": "select d.doc_id, d.source, l.quality from {documents} d left join {labels} l on d.doc_id = l.doc_id",
    "answer_parsing": "select conv_id, turn, case when lower(text) like '%the%' then 1 when lower(text) like '%der%' then 0 else -1 end as answer from {conversations}",
    "inventory_status": "select p_partkey, coalesce(status, 'pending') as status from {part} left join (select l_partkey, max(l_linestatus) as status from {lineitem} group by l_partkey) s on p_partkey = l_partkey",
    "pair_list_membership": "select d.source, count(*) as n, count(p.doc_id) as in_pairs, round(count(p.doc_id) / cast(count(*) as double), 9) as share from {documents} d left join (select distinct doc_id from {labels} where quality = 0) p on d.doc_id = p.doc_id group by d.source",
    "stage_lookup": "select e.epoch, coalesce(s.stage, 'all') as stage from (select distinct cast(l_quantity as int) as epoch from {lineitem}) e left join (select 0 as lo, 3 as hi, 'head' as stage union all select 3, 13, 'top' union all select 13, 40, 'all') s on e.epoch >= s.lo and e.epoch < s.hi",
    "clinical_unpivot": "select p_partkey, side, v from (select p_partkey, 'L' as side, p_size as v from {part} union all select p_partkey, 'R' as side, cast(floor(p_retailprice) as int) as v from {part}) t where v is not null and v > 5",
    "manifest_union": "select o_orderkey as id, 'orders' as source, 'table' as modality from {orders} union all select doc_id, 'documents', 'text' from {documents} union all select vec_id, 'embeddings', 'vector' from {embeddings}",
    "id_overlap": "select count(*) as shared from (select doc_id from {documents} intersect select doc_id from {labels}) t",
    # windows
    "log_durations": "select event_id, user_id, epoch_gap from (select event_id, user_id, {EPOCH} as epoch_gap from {events}) t where epoch_gap is not null",
    "early_stop_replay": "select user_id, event_id, best, improved from (select user_id, event_id, value, max(value) over (partition by user_id order by event_id rows between unbounded preceding and current row) as best, case when value > coalesce(max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as improved from {events}) t",
    "running_patience": "select user_id, event_id, sum(1) over (partition by user_id, run order by event_id rows between unbounded preceding and current row) - 1 as stale from (select user_id, event_id, sum(improved) over (partition by user_id order by event_id rows between unbounded preceding and current row) as run from (select user_id, event_id, case when value > coalesce(max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as improved from {events}) a) b",
    "best_epoch": "select user_id, event_id as best_event from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rn from {events}) t where rn = 1",
    "top_outliers": "select event_id, event_type, round(z, 6) as z from (select event_id, event_type, z, row_number() over (partition by event_type order by abs(z) desc, event_id) as rn from (select event_id, event_type, (value - avg(value) over (partition by event_type)) / nullif(stddev_pop(value) over (partition by event_type), 0) as z from {events}) a) b where rn <= 36",
    "errors_per_source": "select doc_id, source from (select d.doc_id, d.source, row_number() over (partition by d.source order by n_chars desc, d.doc_id) as rn from {documents} d join {labels} l on d.doc_id = l.doc_id where quality = 0) t where rn <= 3",
    "most_confident_error": "select source, max(least(n_chars / 4000.0, 1.0)) as confidence from {documents} d join {labels} l on d.doc_id = l.doc_id where quality = 0 group by source",
    "curve_washout": "select l_orderkey, max(l_extendedprice) as peak, min(case when rn = 1 then l_extendedprice end) as first_v, min(case when rn = n then l_extendedprice end) as last_v from (select l_orderkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn, count(*) over (partition by l_orderkey) as n from {lineitem}) t group by l_orderkey having count(*) >= 2",
    "side_agreement": "select round(avg(case when same then 1.0 else 0.0 end), 9) as share from (select l_linestatus = 'O' and o_orderstatus <> 'F' or l_linestatus = 'F' and o_orderstatus <> 'O' as same from {lineitem} join {orders} on l_orderkey = o_orderkey) t",
    # pixels: an embedding is an 8 x 8 image
    "px_quality": "select vec_id, round(avg(v), 6) as brightness, round(stddev_samp(v), 6) as contrast, round(min(v), 6) as low, round(max(v), 6) as high, round(max(v) - min(v), 6) as spread from {GRID} group by vec_id",
    "px_entropy": "select vec_id, round(-sum(p * ln(p) / ln(2.0)), 6) as entropy from (select vec_id, n / 64.0 as p from (select vec_id, b, count(*) as n from (select vec_id, floor((v + 1.0) * 16.0) as b from {GRID}) a group by vec_id, b) c) d group by vec_id",
    "px_laplacian": "select vec_id, round(var_pop(lap), 6) as sharpness from (select vec_id, coalesce(lag(v) over (partition by vec_id, y order by x), v) + coalesce(lead(v) over (partition by vec_id, y order by x), v) + coalesce(lag(v) over (partition by vec_id, x order by y), v) + coalesce(lead(v) over (partition by vec_id, x order by y), v) - 4 * v as lap from {GRID}) t group by vec_id",
    "px_otsu": "select vec_id, level from (select vec_id, level, row_number() over (partition by vec_id order by w0 * w1 * (s0 / nullif(w0, 0) - s1 / nullif(w1, 0)) * (s0 / nullif(w0, 0) - s1 / nullif(w1, 0)) desc nulls last, level) as rn from (select a.vec_id, a.level, cast(sum(case when b.level <= a.level then b.n else 0 end) as double) as w0, cast(sum(case when b.level > a.level then b.n else 0 end) as double) as w1, cast(sum(case when b.level <= a.level then b.n * b.level else 0 end) as double) as s0, cast(sum(case when b.level > a.level then b.n * b.level else 0 end) as double) as s1 from (select vec_id, cast(floor((v + 1.0) * 16.0) as int) as level, count(*) as n from {GRID} group by vec_id, cast(floor((v + 1.0) * 16.0) as int)) a join (select vec_id, cast(floor((v + 1.0) * 16.0) as int) as level, count(*) as n from {GRID} group by vec_id, cast(floor((v + 1.0) * 16.0) as int)) b on a.vec_id = b.vec_id group by a.vec_id, a.level) t) u where rn = 1",
    "px_bbox": "select vec_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, count(*) as area, round(avg(x), 6) as cx, round(avg(y), 6) as cy from {GRID} where v > 0.15 group by vec_id",
    "px_perimeter": "select vec_id, count(*) as edge_pixels from (select m.vec_id, m.x, m.y, count(o.x) as around from {GRID} m left join (select vec_id, x, y from {GRID} where v > 0) o on m.vec_id = o.vec_id and abs(m.x - o.x) + abs(m.y - o.y) = 1 where m.v > 0 group by m.vec_id, m.x, m.y) t where around < 4 group by vec_id",
    "px_mean_std_image": "select label, i, round(avg(v), 6) as mean_v, round(stddev_pop(v), 6) as std_v from {GRID} group by label, i",
    "px_mip": "select label, y, x, round(max(v), 6) as top from {GRID} group by label, y, x",
    "px_column_profile": "select vec_id, round(min(m), 6) as darkest, round(max(m), 6) as brightest from (select vec_id, x, avg(v) as m from {GRID} group by vec_id, x) t group by vec_id",
    "px_tiles": "select vec_id, cast(floor(y / 4) as int) as ty, cast(floor(x / 4) as int) as tx, round(avg(v) / nullif(stddev_pop(v), 0), 5) as snr from {GRID} group by vec_id, cast(floor(y / 4) as int), cast(floor(x / 4) as int)",
    "px_window": "select g.vec_id, g.i, round(least(greatest((v - lo) / nullif(hi - lo, 0), 0.0), 1.0), 6) as v from {GRID} g join (select vec_id, percentile_cont(0.05) within group (order by v) as lo, percentile_cont(0.95) within group (order by v) as hi from {GRID} group by vec_id) w on g.vec_id = w.vec_id",
    "px_znorm": "select g.vec_id, g.i, round((v - m) / nullif(s, 0), 6) as v from {GRID} g join (select vec_id, avg(v) as m, stddev_pop(v) as s from {GRID} group by vec_id) w on g.vec_id = w.vec_id",
    "px_crop_pad": "select vec_id, y - 2 as y, x - 2 as x, round(v, 6) as v from {GRID} where y between 2 and 5 and x between 2 and 5",
    # evaluation, joins and pixels of the second batch
    "ovr_auc": "select cls, round((sum(case when y = 1 then r else 0.0 end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * 1.0 * sum(1 - y), 0), 9) as auc from (select cls, y, rank() over (partition by cls order by v) + (count(*) over (partition by cls, v) - 1) / 2.0 as r from (select i as cls, case when label = i then 1 else 0 end as y, v from {GRID} where i < 10) a) b group by cls",
    "sensitivity_at_specificity": "select source, round(ltpr + (0.1 - lfpr) * (tpr - ltpr) / (fpr - lfpr), 9) as sensitivity from (select source, fpr, tpr, coalesce(lag(fpr) over (partition by source order by score desc), 0.0) as lfpr, coalesce(lag(tpr) over (partition by source order by score desc), 0.0) as ltpr from (select source, score, sum(q) over (partition by source order by score desc rows unbounded preceding) / nullif(cast(sum(q) over (partition by source) as double), 0) as fpr, sum(p) over (partition by source order by score desc rows unbounded preceding) / nullif(cast(sum(p) over (partition by source) as double), 0) as tpr from (select source, n_chars as score, sum(quality) as p, sum(1 - quality) as q from {documents} d join {labels} l on d.doc_id = l.doc_id group by source, n_chars) a) b) c where lfpr <= 0.1 and fpr > 0.1",
    "manifest_verification": "select coalesce(e.path, a.path) as path, case when a.path is null then 'missing' when e.path is null then 'new' when e.digest <> a.digest then 'changed' else 'ok' end as status from (select o_orderkey as path, md5(o_orderstatus) as digest from {orders}) e full outer join (select l_orderkey as path, md5(max(l_linestatus)) as digest from {lineitem} group by l_orderkey) a on e.path = a.path",
    "nearest_slice": "select p_partkey, l_orderkey, l_linenumber, gap from (select p_partkey, l_orderkey, l_linenumber, abs(l_quantity - p_size) as gap, row_number() over (partition by p_partkey order by abs(l_quantity - p_size), l_orderkey, l_linenumber, l_suppkey) as rn from {part} join {lineitem} on p_partkey = l_partkey) t where rn = 1",
    "phase_slice_grid": "select l_orderkey, l_linenumber, l_partkey, dense_rank() over (partition by l_orderkey order by l_returnflag) as phase, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey) as slice_no from {lineitem}",
    "priority_label": "select l_orderkey, case when max(case when l_returnflag = 'R' then 1 else 0 end) = 1 then 'malignant' when max(case when l_returnflag = 'A' then 1 else 0 end) = 1 then 'benign' else 'normal' end as label, count(*) as findings, min(l_quantity - l_linenumber) as x0, max(l_quantity + l_linenumber) as x1 from {lineitem} group by l_orderkey",
    "majority_baseline": "select source, round(max(n) / cast(sum(n) as double), 9) as chance from (select source, quality, count(*) as n from {documents} d join {labels} l on d.doc_id = l.doc_id group by source, quality) t group by source",
    "evenly_spaced": "select user_id, k, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as r, count(*) over (partition by user_id) as n from {events}) e join (select 0 as k union all select 1 union all select 2 union all select 3) s on r = {HALF_EVEN}(k * (n - 1) / 3.0, 0)",
    "cross_entropy_by_source": "select source, round(avg(-ln(case when quality = 1 then p else 1.0 - p end)), 9) as loss from (select source, quality, 1.0 / (1.0 + exp(-n_chars / 4000.0)) as p from {documents} d join {labels} l on d.doc_id = l.doc_id) t group by source",
    "box_pad_mirror": "select p_partkey, greatest(600 - x1 - 10, 0) as x0, least(600 - x0 + 10, 600) as x1 from (select p_partkey, p_size * 10 as x0, p_size * 10 + 50 as x1 from {part}) t where x1 <= 600",
    "px_noise": "select vec_id, round(sqrt(pi() / 2.0) * avg(abs(u - 2 * h + d)) / 6.0, 6) as sigma from (select vec_id, x, y, h, lag(h) over (partition by vec_id, x order by y) as u, lead(h) over (partition by vec_id, x order by y) as d from (select vec_id, x, y, lag(v) over (partition by vec_id, y order by x) - 2 * v + lead(v) over (partition by vec_id, y order by x) as h from {GRID}) a) b where h is not null and u is not null and d is not null group by vec_id",
    "px_blockiness": "select vec_id, round(avg(case when x % 4 = 0 then g end) / nullif(avg(case when x % 4 <> 0 then g end), 0), 6) as blockiness from (select vec_id, x, abs(v - lag(v) over (partition by vec_id, y order by x)) as g from {GRID}) t where g is not null group by vec_id",
    "px_block_mean": "select vec_id, cast(floor(y / 2) as int) as y, cast(floor(x / 2) as int) as x, round(avg(v), 6) as v from {GRID} group by vec_id, cast(floor(y / 2) as int), cast(floor(x / 2) as int)",
    "px_equalise": "select vec_id, level, round(sum(n) over (partition by vec_id order by level rows unbounded preceding) / 64.0, 6) as cdf from (select vec_id, cast(floor((v + 1.0) * 16.0) as int) as level, count(*) as n from {GRID} group by vec_id, cast(floor((v + 1.0) * 16.0) as int)) t",
    "px_erosion": "select vec_id, y, x from (select vec_id, y, x, v, least(lag(v) over (partition by vec_id, y order by x), lead(v) over (partition by vec_id, y order by x), lag(v) over (partition by vec_id, x order by y), lead(v) over (partition by vec_id, x order by y)) as low, case when x between 1 and 6 and y between 1 and 6 then 1 else 0 end as inner_px from {GRID}) t where v > -0.05 and low > -0.05 and inner_px = 1",
    "px_dilation": "select vec_id, y, x from (select vec_id, y, x, v, greatest(coalesce(lag(v) over (partition by vec_id, y order by x), -9.0), coalesce(lead(v) over (partition by vec_id, y order by x), -9.0), coalesce(lag(v) over (partition by vec_id, x order by y), -9.0), coalesce(lead(v) over (partition by vec_id, x order by y), -9.0)) as top from {GRID}) t where v > 0.15 or top > 0.15",
    "px_ring_contrast": "select vec_id, round(abs(avg(case when m = 1 then v end) - avg(case when m = 0 then v end)) / nullif(stddev_pop(case when m = 0 then v end), 0), 5) as cnr from (select vec_id, v, case when v > 0.15 then 1 else 0 end as m, greatest(coalesce(lag(v) over (partition by vec_id, y order by x), -9.0), coalesce(lead(v) over (partition by vec_id, y order by x), -9.0), coalesce(lag(v) over (partition by vec_id, x order by y), -9.0), coalesce(lead(v) over (partition by vec_id, x order by y), -9.0)) as top from {GRID}) t where m = 1 or top > 0.15 group by vec_id",
    "px_kinetic_curve": "select vec_id, phase, round(avg(v), 6) as mean_v, round(max(v), 6) as peak from (select vec_id, y % 4 as phase, v from {GRID} where x between 2 and 5) t group by vec_id, phase",
    "px_volume_stats": "select label, count(*) as voxels, count(distinct vec_id) as slices, min(x) as x0, max(x) as x1, round(avg(x), 6) as cx, round(avg(y), 6) as cy, round(count(*) * 0.008, 6) as ml from {GRID} where v > 0.15 group by label",
    "px_ssim_global": "select vec_id, round((2 * ma * mb + 0.0001) * (2 * cov + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009)), 6) as ssim from (select a.vec_id, avg(a.v) as ma, avg(b.v) as mb, var_pop(a.v) as va, var_pop(b.v) as vb, covar_pop(a.v, b.v) as cov from {GRID} a join {GRID} b on b.vec_id = a.vec_id + 1 and b.i = a.i group by a.vec_id) t",
    "px_slice_choice": "select vec_id, y from (select vec_id, y, row_number() over (partition by vec_id order by y) - 1 as r, count(*) over (partition by vec_id) as n from (select vec_id, y from {GRID} where v > 0.0 group by vec_id, y having count(*) >= 4) a) b where abs(r - floor(n / 2)) <= 1",
}
EPOCH = "epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)"


def _duck(text: str) -> str:
    text = text.replace("{GRID}", GRID.replace("{px}", PX)).replace("{EPOCH}", EPOCH).replace("{HALF_EVEN}", "round_even").replace("left anti join", "anti join")
    # decimal literals are doubles on both sides
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1::double", re.sub(r"\{(\w+)\}", r"\1", text))


SQL = {name: _duck(text) for name, text in TEXT.items()}
