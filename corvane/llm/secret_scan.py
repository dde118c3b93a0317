"""Secret detection over an incremental blob ledger, all in JVM expressions.

Every version of every text is a blob, named by the SHA-256 of its content. A scan takes only the pairs of blob
and rule version that the ledger lacks, scans each blob once however many paths hold it, and joins findings back
to all paths. The ledger is a plain table, so the next scan of a grown corpus reads only what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.text import RUN_BLOCK, running

SPAN = "struct<kind:string,start:int,end:int,digest:string>"

# The three base kinds; regex, the group that must be long enough, its least length.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]+)", 1, 32),
)

# Further kinds by the method: kind, keyword (must occur), regex, group, least length.
EXTRA = (
    ("pem", "PRIVATE KEY-----", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    ("github", "gh", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40),
    ("slack", "xox", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15),
    ("google", "AIza", r"(AIza[A-Za-z0-9_-]{35})", 1, 39),
    ("stripe", "_live_", r"([rs]k_live_[A-Za-z0-9]{16,})", 1, 24),
    ("jwt", "eyJ", r"((?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 28),
    ("bearer", "earer", r"([Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*)", 1, 27),
    ("url", "://", r"((?<![a-z])[a-z][a-z0-9+.-]{0,30}://[^\s:/@]+:[^\s:/@]+@[^\s/]+)", 1, 1),
)

RULE_VERSION = "2024-1"
KINDS = [r[0] for r in BASE] + [r[0] for r in EXTRA]


def _spans(text: Column, kind: str, regex: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches in code points, less those whose group is too short.

    A match starts after the sum of all that was split off before it; the time is in proportion to text and matches.
    """
    gaps, hits, keys = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    each = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), keys.alias("key")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.when(F.length(x["key"]) >= least, F.sha2(x["key"], 256)).alias("digest")),
    )
    told = lambda at, x: F.struct(F.lit(kind).alias("kind"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["hit"]).alias("end"), x["digest"].alias("digest"))
    placed = running(F.filter(each, lambda x: x["hit"].isNotNull()), F.lit(0), lambda at, x: at + x["gap"] + x["hit"], told, SPAN)
    return F.filter(placed, lambda x: x["digest"].isNotNull())


def _hex_spans(text: Column, least: int) -> Column:
    """The hex kind: a run is maximal, so that runs of the least length can be looked for directly."""
    return _spans(text, "hex", rf"(?<![0-9a-f])([0-9a-f]{{{least},}})(?![0-9a-f])", 1, least)


def _may_hold(text: Column, low: Column) -> Column:
    """False only if no rule can match."""
    gate = text.contains("AKIA") | text.rlike("[0-9a-f]{32}")
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        gate = gate | low.contains(word)
    for _, keyword, *_ in EXTRA:
        gate = gate | text.contains(keyword)
    return gate


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob_id, spans of blobs(blob_id, text), ordered by start and then by rule."""
    text = F.col("text")
    base = [_hex_spans(text, r[3]) if r[0] == "hex" else _spans(text, *r) for r in BASE]
    extra = [F.when(text.contains(keyword), _spans(text, kind, regex, group, least)) for kind, keyword, regex, group, least in EXTRA]
    found = blobs.select("blob_id", *[F.coalesce(c, F.array()).cast(f"array<{SPAN}>").alias(f"k{i}") for i, c in enumerate(base + extra)])
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    spans = F.concat(*[F.col(f"k{i}") for i in range(len(KINDS))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s.alias("span"))))
    return found.select("blob_id", F.transform(keyed, lambda k: k["span"]).alias("spans"))


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """blob_id, rule_version, spans for the blobs of versions that the ledger has not seen under rule_version.

    Only blobs that a rule may match travel: the rest are recorded as scanned, without spans, by id alone. Equal
    blobs are merged before the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = versions.select(F.unhex(F.sha2(text, 256)).alias("blob_id"), text.alias("text"), _may_hold(text, F.lower(text)).alias("open"))
    named = named.select("blob_id", F.when(F.col("open"), F.col("text")).alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob_id").distinct()
        named = named.join(seen, "blob_id", "left_anti")
    held = named.where("text is not null").groupBy("blob_id").agg(F.any_value("text").alias("text"))
    idle = named.where("text is null").select("blob_id").distinct().select("blob_id", F.array().cast(f"array<{SPAN}>").alias("spans"))
    return scan_blobs(held).union(idle).select("blob_id", F.lit(rule_version).alias("rule_version"), "spans")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """doc_id, blob_id, spans for every row of docs: findings of new blobs and of those in the ledger.

    spans is an array of (kind, start, end, digest) in code points, end exclusive, ordered by start and rule; digest
    is the SHA-256 of what the rule takes for the secret, so that a stored ledger keeps none in clear. A null text is the empty blob and has no spans. Null ids pass through; repeated rows and equal texts repeat
    their result and are scanned once; other columns of docs are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob_id"))
    fresh = scan_new(docs, ledger, text_col, rule_version)
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == rule_version).select("blob_id", "rule_version", "spans"))
    found = known.where(F.size("spans") > 0).select("blob_id", "spans").dropDuplicates(["blob_id"])
    return paths.join(found, "blob_id", "left").select("doc_id", "blob_id", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def _cover(spans: Column) -> Column:
    """(kind, start, end) of the parts of the text that spans cover: what overlaps an earlier span belongs to that."""
    part = "struct<kind:string,start:int,end:int>"
    told = lambda reach, x: F.struct(F.when(x["start"] >= reach, x["kind"]).alias("kind"), F.greatest(reach, x["start"]).alias("start"), F.greatest(reach, x["end"]).alias("end"))
    return F.filter(running(spans, F.lit(0), lambda reach, x: F.greatest(reach, x["end"]), told, part), lambda x: x["end"] > x["start"])


def _replaced(text: Column, parts: Column) -> Column:
    """text with each of parts replaced by <kind>, or by nothing without one.

    The text is first cut at every RUN_BLOCK-th part and the pieces at each, as a place in a long text is found by
    counting from its front.
    """

    def block(x: Column, held: Column) -> Column:
        """The text from the end of the part before the block's first up to the end of its last."""
        own, begin = x["parts"], x["begin"]
        piece = F.substring(held, begin + 1, F.element_at(own, -1)["end"] - begin)
        kept = F.transform(own, lambda p, i: F.struct(F.when(i == 0, begin).otherwise(F.get(own, i - 1)["end"]).alias("from"), p.alias("p")))
        spell = lambda c, h: F.concat(F.substring(h["piece"], c["from"] - begin + 1, c["p"]["start"] - c["from"]), F.coalesce(F.concat(F.lit("<"), c["p"]["kind"], F.lit(">")), F.lit("")))
        return F.array_join(F.flatten(F.transform(F.array(F.struct(piece.alias("piece"), kept.alias("kept"))), lambda h: F.transform(h["kept"], lambda c: spell(c, h)))), "")

    def whole(a: Column) -> Column:
        count = F.size(a["parts"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / RUN_BLOCK).cast("int")), lambda b: F.struct(F.slice(a["parts"], b * RUN_BLOCK + 1, RUN_BLOCK).alias("parts"), F.get(a["ends"], b * RUN_BLOCK).alias("begin")))
        return F.concat(F.array_join(F.transform(blocks, lambda x: block(x, a["text"])), ""), F.substring(a["text"], F.element_at(a["ends"], -1) + 1, F.length(a["text"])))

    ends = F.concat(F.array(F.lit(0)), F.transform(parts, lambda p: p["end"]))
    return F.get(F.transform(F.array(F.struct(text.alias("text"), parts.alias("parts"), ends.alias("ends"))), whole), 0)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret span of its text replaced by <kind>; found through the ledger, joined on the blob.

    Of overlapping spans the earliest gives its kind to its own part, and what reaches beyond it goes with no mark
    of its own. Texts without a secret, and null texts, stay as they are.
    """
    found = scan_new(docs, None, text_col).where(F.size("spans") > 0).select(F.col("blob_id").alias("_blob"), _cover(F.col("spans")).alias("_parts"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.withColumn("_blob", F.unhex(F.sha2(text, 256))).join(found, "_blob", "left").withColumn("_text", text)
    return held.withColumn(text_col, F.when(F.size("_parts") > 0, _replaced(F.col("_text"), F.col("_parts"))).otherwise(F.col(text_col))).select(*docs.columns)
