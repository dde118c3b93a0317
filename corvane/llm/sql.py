"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import re

from corvane.llm import secret_scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kind(at: int, kind: str, regex: str, group: int, least: int) -> str:
    """Spans of one kind: starts are sums of the lengths of what stands before a match.

    A character that must not stand before a match is matched with it, as group 1, and left out of the span.
    """
    lead, kept = "0", f"length(keys[i]) >= {least}"
    if m := re.fullmatch(r"\(\(\?<!\[(.+?)\]\)(.+)\)", regex):
        regex, group, lead = f"(^|[^{m[1]}])({m[2]})", 2, "length(hits[i]) - length(keys[i])"
    r = _quoted(regex.replace(r"[^\s", r"[^\x20\t-\r"))
    return (
        f"select doc_id, {at} as rank, '{kind}' as kind, s + {lead} as start, s + length(hits[i]) as stop from (select doc_id, i, hits, keys, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) as s"
        f" from (select doc_id, string_split_regex(text, {r}) as gaps, regexp_extract_all(text, {r}, 0) as hits, regexp_extract_all(text, {r}, {group}) as keys, unnest(range(1, len(regexp_extract_all(text, {r}, 0)) + 1)) as i from docs) a) b where {kept}"
    )


def _secrets() -> str:
    rules = [(k, r"([0-9a-f]{32,})" if k == "hex" else r, g, n) for k, r, g, n in secret_scan.BASE] + [(k, r, g, n) for k, _, r, g, n in secret_scan.EXTRA]
    spans = " union all ".join(_kind(at, *rule) for at, rule in enumerate(rules))
    spelt = lambda where: f"coalesce(string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, rank) filter ({where}), '')"
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k, *_ in secret_scan.BASE)
    return (
        f"with docs as (select doc_id, coalesce(text, '') as text from documents), spans as ({spans})"
        f" select d.doc_id, {counts}, sha256({spelt(f'rank < {len(secret_scan.BASE)}')}) as base_sha256, {spelt('kind is not null')} as spans from docs d left join spans s on d.doc_id = s.doc_id group by d.doc_id"
    )


def _near_duplicates(width: int, percent: int) -> str:
    """All pairs that share a shingle, counted; then reachability."""
    run = " || chr(10) || ".join(f"words[i + {k}]" for k in range(width))
    return f"""with recursive worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words from documents),
sets as (select doc_id, case when len(words) >= {width} then list_distinct(list_transform(range(1, len(words) - {width} + 2), lambda i: {run})) when len(words) > 0 then [array_to_string(words, chr(10))] else [] end as shingles from worded),
sizes as (select doc_id, len(shingles) as n from sets),
each as (select doc_id, unnest(shingles) as shingle from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from each a join each b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * common >= {percent} * (x.n + y.n - common)),
ways as (select a, b from links union select b, a from links),
reach as (select doc_id as a, doc_id as b from sizes union select r.a, w.b from reach r join ways w on r.b = w.a)
select s.doc_id, s.n as n_shingles, min(r.b) as component_id, s.doc_id = min(r.b) as kept from sizes s join reach r on s.doc_id = r.a group by s.doc_id, s.n"""


def _nearest(k: int, every: int) -> str:
    """Brute force in double precision, a dimension after another."""
    product = "list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))"
    usable = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return (
        f"with points as (select distinct vec_id, embedding::double[] as v from embeddings where {usable}),"
        f" scored as (select q.vec_id as query_id, c.vec_id as vec_id, {product} as score from points q join points c on q.vec_id <> c.vec_id where q.vec_id % {every} = 0)"
        f" select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) t where rank <= {k}"
    )


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, folded a byte at a time."""
    steps = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        steps.append(c)
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    fold = f"list_reduce({octets}, lambda c, b: xor(c >> 8, ({steps}::bigint[])[(xor(c, b) & 255) + 1]), 4294967295::bigint)"
    return f"xor({fold}, 4294967295::bigint)"


def _spelling(least_length: int, least_count: int, every: int, ratio: int) -> str:
    """Near words by what is left of them without one character."""
    return f"""with recursive runs as (select doc_id, translate(run, '{UPPER}', '{LOWER}') as run, count(*) as k from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents) group by 1, 2),
hashed as (select run, k, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs where length(run) >= {least_length}),
spelt as (select case when h % {every} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed),
words as (select word, sum(k)::bigint as n from spelt where length(word) >= {least_length} group by word having sum(k) >= {least_count}),
less as (select word, n, gap, substr(word, 1, gap) || substr(word, gap + 2) as rest from (select word, n, unnest(range(length(word)))::int as gap from words)),
pairs as (select a.word, b.word as near, b.n as near_n from less a join less b on a.rest = b.rest and a.gap = b.gap and a.word <> b.word
 union select a.word, b.word, b.n from less a join words b on a.rest = b.word union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(near_n) as most, arg_min(near, (-near_n, near)) as near from pairs group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= {ratio} * w.n then near end as form, case when most >= {ratio} * w.n then most end as form_n from words w left join best b on w.word = b.word),
walk as (select word, word as last from formed union select w.word, f.form from walk w join formed f on w.last = f.word where f.form is not null)
select f.word, f.form, w.last as root, f.n, f.n_near, f.form_n from formed f join walk w on f.word = w.word join formed l on l.word = w.last where l.form is null"""


def oracle_sql() -> dict[str, str]:
    return {"op8_secret_scans": _secrets(), "op9_nearest_vectors": _nearest(20, 20), "op10_minhash_dedup": _near_duplicates(3, 85), "op11_spelling_variants": _spelling(7, 2, 31, 10)}
