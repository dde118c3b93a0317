"""Line-first cleaning: rules drop lines, then documents that lost too much text, all in JVM expressions.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go; a document is rejected
if it fails the base counts or keeps too small a share of its word characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.text import SPACE_RUN, space_words, windows3

#: Positions take the low bits of a sort key, window hashes the rest; longer texts go the exact way.
POSITION_BITS = 24

# Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "cookie policy",
    "use of cookies",
    "uses cookies",
    "accept cookies",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "click here",
    "read more",
    "sign up",
    "sign in",
    "log in",
    "subscribe to our newsletter",
    "share on facebook",
    "share on twitter",
    "skip to content",
    "back to top",
    "add to cart",
    "page not found",
    "powered by",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookies akzeptieren",
    "javascript aktivieren",
    "weiterlesen",
    "mehr erfahren",
    "hier klicken",
    "newsletter abonnieren",
    "auf facebook teilen",
    "zum inhalt springen",
    "nach oben",
    "in den warenkorb",
    "seite nicht gefunden",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "mentions légales",
    "accepter les cookies",
    "activer javascript",
    "lire la suite",
    "en savoir plus",
    "cliquez ici",
    "abonnez-vous",
    "partager sur facebook",
    "aller au contenu",
    "haut de page",
    "ajouter au panier",
    "page introuvable",
    "todos los derechos reservados",
    "política de privacidad",
    "términos y condiciones",
    "aviso legal",
    "aceptar cookies",
    "activar javascript",
    "leer más",
    "más información",
    "haga clic aquí",
    "suscríbete",
    "compartir en facebook",
    "saltar al contenido",
    "volver arriba",
    "añadir al carrito",
    "página no encontrada",
)


# The phrases as whole words, with any white space between them.
def _any_of(phrases: list[str], depth: int = 2) -> str:
    """An alternation that branches by letter first, so that a word is held against few phrases; their order stays."""
    if depth == 0 or "" in phrases:
        return "(?:" + "|".join(p.replace(" ", SPACE_RUN) for p in phrases) + ")"
    first = dict.fromkeys(p[0] for p in phrases)
    return "(?:" + "|".join(c.replace(" ", SPACE_RUN) + _any_of([p[1:] for p in phrases if p[0] == c], depth - 1) for c in first) + ")"


FURNITURE = r"(?<![\p{L}\p{M}\p{N}_])" + _any_of(list(BOILERPLATE)) + r"(?![\p{L}\p{M}\p{N}_])"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _furniture_share(line: Column) -> Column:
    """Share of the boilerplate phrases in the characters of a line, 0 without any."""
    low = F.lower(line)
    chars = lambda x: F.length(F.regexp_replace(x, SPACE_RUN, ""))
    return F.when(low.rlike(FURNITURE), 1 - chars(F.regexp_replace(low, FURNITURE, "")) / chars(low)).otherwise(0.0)


def line_verdicts(
    lines: Column, max_symbol_share: float, max_shout_share: float, max_link_share: float, min_distinct_share: float, short_words: int = 10, max_furniture_share: float = 0.3
) -> Column:
    """Array of (line, chars, rule) for an array of lines; rule is null for a line that stays.

    Boilerplate phrases fail a line of at most short_words words, and a longer one if they make up more than
    max_furniture_share of its characters.
    """
    parts = F.transform(lines, lambda l: F.struct(l.alias("line"), space_words(l).alias("words")))
    facts = F.transform(
        parts,
        lambda p: F.struct(
            p["line"].alias("line"),
            F.length(F.regexp_replace(p["line"], SPACE_RUN, "")).alias("chars"),
            F.size(p["words"]).alias("n"),
            F.size(F.array_distinct(p["words"])).alias("distinct"),
            _count(p["line"], r"[#*$%&|<>{}=\\^~]+").alias("symbols"),
            _count(p["line"], r"[A-Z]+").alias("upper"),
            _count(p["line"], r"[a-z]+").alias("lower"),
            F.size(F.filter(p["words"], lambda w: w.isin("|", "»", "›", "•", "·", "::", ">", ">>"))).alias("separators"),
            (_count(p["line"], r"[!?]{2,}") / 2).alias("bangs"),
            p["line"].rlike(r"[.!?:;\u2026\"')\]]\s*$").alias("closed"),
            _furniture_share(p["line"]).alias("furniture"),
        ),
    )
    rule = lambda f: (
        F.when((f["furniture"] > 0) & ((f["n"] <= short_words) | (f["furniture"] > max_furniture_share)), "boilerplate")
        .when((f["separators"] >= 3) & (f["separators"] > f["n"] * max_link_share), "navigation")
        .when(f["symbols"] > f["chars"] * max_symbol_share, "symbols")
        .when((f["n"] >= 3) & (f["upper"] > (f["upper"] + f["lower"]) * max_shout_share) & (f["upper"] >= 8), "shouting")
        .when((f["n"] >= 3) & (f["bangs"] * 2 > f["n"]), "punctuation")
        .when((f["n"] >= 10) & (f["distinct"] < f["n"] * min_distinct_share), "repetition")
        .when((f["n"] < 3) & ~f["closed"], "fragment")
    )
    return F.transform(facts, lambda f: F.struct(f["line"].alias("line"), f["chars"].cast("long").alias("chars"), rule(f).alias("rule")))


def _covered(starts: Column) -> Column:
    """Words under the 3-word windows that start at the sorted positions starts."""
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3).cast("long")))
    return F.when(F.size(starts) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g))


def with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words that stand in a 3-word window found twice or more.

    Windows are found again by sorting keys of 40 hash bits and the position. Neighbours of equal hash are then
    compared word by word; if any differ (two windows share a hash), or if the positions don't fit, that row's
    windows are sorted as text instead. So the count is exact.
    """
    low = (1 << POSITION_BITS) - 1
    w = F.col(words)
    ok = F.size(w) <= low
    keys = F.sort_array(F.transform(windows3(w), lambda h, i: h.bitwiseAND(~low).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_keys", F.when(ok, keys).otherwise(F.array().cast("array<bigint>")))
    k, n = F.col("_keys"), F.size(F.col("_keys"))
    high = lambda x: F.shiftright(x, POSITION_BITS)
    twin = F.zip_with(F.slice(k, 1, F.greatest(n - 1, F.lit(0))), F.slice(k, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(high(a) == high(b), F.struct(a.bitwiseAND(low).cast("int").alias("p"), b.bitwiseAND(low).cast("int").alias("q"))))
    df = df.withColumn("_twins", F.filter(twin, lambda t: t.isNotNull()))
    at = lambda p, d: F.get(w, p + d)
    clash = F.exists("_twins", lambda t: (at(t["p"], 0) != at(t["q"], 0)) | (at(t["p"], 1) != at(t["q"], 1)) | (at(t["p"], 2) != at(t["q"], 2)))
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform("_twins", lambda t: F.array(t["p"].cast("long"), t["q"].cast("long"))))))
    df = df.withColumn("_plain", ok & ~clash).withColumn("_starts", F.when(F.col("_plain"), starts))
    size = F.size(w)
    text_windows = F.sort_array(F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.cast("long").alias("i"))))
    df = df.withColumn("_sorted", F.when(~F.col("_plain") & (size >= 3), text_windows))
    s = F.col("_sorted")
    pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<bigint>")))
    exact = F.sort_array(F.array_distinct(F.flatten(pairs)))
    df = df.withColumn("_starts", F.coalesce("_starts", exact, F.array().cast("array<bigint>")))
    return df.withColumn(out, _covered(F.col("_starts"))).drop("_keys", "_twins", "_plain", "_sorted", "_starts")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_kept_share: float = 0.5,
    max_symbol_share: float = 0.1,
    max_shout_share: float = 0.7,
    max_link_share: float = 0.2,
    min_distinct_share: float = 0.25,
    short_words: int = 10,
    max_furniture_share: float = 0.3,
) -> DataFrame:
    """One row per row of docs: counts, base_failed, kept_share, clean_text and kept.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_share (word characters
    left after failing lines went), dropped_rules (the rule of each line that went, in order), clean_text, kept. A null or
    blank text has no words, fails the base counts and is not kept; null ids pass through; rows are independent,
    so repeated rows repeat their result; other columns of docs are ignored.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.select("doc_id", "text", F.split("text", "\n").alias("lines"), space_words(F.col("text")).alias("words"))
    df = with_repeats(df, "words", "n_repeat_words")
    worded = F.filter("lines", lambda l: F.length(F.btrim(l, F.lit(" \t\x0b\x0c\r"))) > 0)
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE_RUN, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        "n_repeat_words",
        worded.alias("worded"),
    )
    df = df.withColumn("verdicts", line_verdicts(F.col("worded"), max_symbol_share, max_shout_share, max_link_share, min_distinct_share, short_words, max_furniture_share))
    left = F.filter("verdicts", lambda v: v["rule"].isNull())
    failed = F.filter("verdicts", lambda v: v["rule"].isNotNull())
    df = df.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)).alias("base_failed"),
        F.coalesce(F.try_divide(F.aggregate(left, F.lit(0).cast("long"), lambda s, v: s + v["chars"]), F.col("word_chars")), F.lit(0.0)).alias("kept_share"),
        F.transform(failed, lambda v: v["rule"]).alias("dropped_rules"),
        F.array_join(F.transform(left, lambda v: v["line"]), "\n").alias("clean_text"),
    )
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept_share))
