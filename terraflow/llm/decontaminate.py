"""Benchmark decontamination by a prefix-filtered set join, DataFrame functions only.

An item's windows are sets of shingles (pairs of neighbouring words). A document
holds a window only if it holds the window's rarest shingle, so that one is its
necessary prefix: documents and windows are joined on it alone. The place of the
shingle gives the place of the window, which must lie inside the document
(positional and length bounds). What is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.llm.common import ascii_lower, materialize, sized

#: Everything in ASCII but digits and small letters; texts are split after A-Z are in lower case, and no other letter changes.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("__k1"), F.hash(text).alias("__k2")]


def split_words(text: Column) -> Column:
    """Words in their places; a text that begins or ends with a break has an empty first or last entry."""
    return F.split(F.coalesce(text, F.lit("")), BREAKS)


def count_words(parts: Column) -> Column:
    last = F.element_at(parts, -1) == ""
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - (last & (F.size(parts) > 1)).cast("int")).cast("long")


def item_windows(benchmark: DataFrame, width: int, item_id: str, text: str) -> DataFrame:
    """One row per item and window: item_id, window (its words) and n.

    A null item_id counts as 'null'. Items without words have no window.
    """
    words = F.filter(F.split(ascii_lower(F.col("t")), BREAKS), lambda w: w != "")
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    items = items.select("item_id", words.alias("w")).withColumn("n", F.least(F.size("w"), F.lit(width))).filter("n > 0")
    starts = items.select("item_id", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    return starts.select("item_id", "n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("window")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """window, n, at (0-based), h: the pairs of each window, or the word of a window of one word."""
    parts = F.split("window", " ")
    rows = windows.select("window", "n").distinct().select("window", "n", parts.alias("p"))
    pairs = rows.select("window", "n", F.posexplode(F.arrays_zip(F.col("p").alias("a"), F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))).alias("b"))).alias("at", "s"))
    return pairs.filter((F.col("n") == 1) | F.col("s.b").isNotNull()).select("window", "n", "at", F.xxhash64("s.a", F.coalesce("s.b", F.lit(""))).alias("h"))


def matches(docs: DataFrame, wanted: DataFrame, text: str, with_words: bool) -> DataFrame:
    """Places in documents of the wanted shingles: __k1, __k2, last (size of the word array), at, h."""
    parts = split_words(ascii_lower(F.col(text)))
    rows = docs.select(*text_key(F.col(text)), parts.alias("p")).withColumn("last", F.size("p"))
    zipped = F.arrays_zip(F.col("p").alias("a"), F.slice("p", 2, F.size("p")).alias("b"))
    pairs = rows.select("__k1", "__k2", "last", F.posexplode(zipped).alias("at", "s"))
    found = pairs.filter(F.col("s.b").isNotNull()).select("__k1", "__k2", "last", "at", F.xxhash64("s.a", "s.b").alias("h"))
    out = found.join(wanted, "h", "left_semi")
    if with_words:
        single = pairs.select("__k1", "__k2", "last", "at", F.xxhash64("s.a", F.lit("")).alias("h"))
        out = out.union(single.select(out.columns).join(wanted, "h", "left_semi").select(out.columns))
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated and the keys of its text.

    Words are the runs of characters other than ASCII breaks, with A-Z in lower
    case. A window is ``width`` neighbouring words of an item, or all words of a
    shorter one; a document word inside an occurrence of a window is hit. Null
    text has no words. Repeated rows give repeated results; an empty benchmark
    hits nothing; extra columns are ignored. Equal texts are worked once.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows = materialize(item_windows(benchmark, width, item_id, item_text), "windows")
    shingles = materialize(window_shingles(windows), "window-shingles")
    wanted = materialize(shingles.select("h").distinct(), "wanted")
    with_words = not shingles.filter("n = 1").isEmpty()
    found = materialize(matches(docs, sized(wanted, 16), "text", with_words), "shingle-places")
    # Rarity over all documents; a window with a shingle that no document holds can't occur.
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    ranked = shingles.join(often, "h", "left").groupBy("window", "n").agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.col("h"), F.col("at").alias("shift"))).alias("p")
    )
    prefix = materialize(ranked.filter("p.often > 0").select("window", "n", "p.h", "p.shift"), "prefixes")
    places = (
        found.join(sized(prefix, 150), "h")
        .withColumn("start", F.col("at") - F.col("shift"))
        .filter("start >= 0 AND start + n <= last")
        .select("__k1", "__k2", "start", "n", "window")
        .distinct()
    )
    tried = materialize(places.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("start", "n", "window")).alias("tried")), "candidates")

    joined = docs.select("doc_id", "text", *text_key(F.col("text"))).join(sized(tried, 2000).hint("shuffle_hash"), ["__k1", "__k2"], "left")
    parts = split_words(ascii_lower(F.col("text")))
    exact = F.filter(
        F.coalesce("tried", F.array().cast("array<struct<start:int,n:int,window:string>>")),
        lambda c: F.array_join(F.slice(F.col("parts"), c["start"] + 1, c["n"]), " ") == c["window"],
    )
    spans = F.array_sort(F.transform("held", lambda c: F.struct(c["start"].alias("start"), (c["start"] + c["n"]).alias("stop"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("stop"), F.lit(0).alias("hit")),
        lambda s, x: F.struct(
            F.greatest(s["stop"], x["stop"]).alias("stop"),
            (s["hit"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["stop"], x["start"]))).alias("hit"),
        ),
        lambda s: s["hit"].cast("long"),
    )
    judged = joined.select("doc_id", "__k1", "__k2", parts.alias("parts"), "tried").select(
        "doc_id", "__k1", "__k2", count_words(F.col("parts")).alias("n_words"), F.when(F.col("tried").isNotNull(), exact).alias("held")
    )
    judged = materialize(
        judged.select(
            "doc_id",
            "__k1",
            "__k2",
            "n_words",
            F.coalesce(F.when(F.size("held") > 0, covered), F.lit(0)).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("held", lambda c: c["window"])).alias("windows"),
        ),
        "judged",
    )
    hit = judged.filter("n_hit > 0").select("__k1", "__k2", F.explode("windows").alias("window")).distinct()
    items = hit.join(sized(windows.select("window", "item_id"), 100), "window").select("__k1", "__k2", "item_id").distinct()
    named = items.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    named = materialize(named.select("__k1", "__k2", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "hit-items")
    return judged.join(sized(named, 100), ["__k1", "__k2"], "left").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "__k1",
        "__k2",
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    hit = contamination(docs, benchmark, width, doc_id, text).filter("contaminated").select("__k1", "__k2").distinct()
    hit = materialize(hit, "contaminated")
    return docs.select("*", *text_key(F.col(text))).join(sized(hit, 32), ["__k1", "__k2"], "left_anti").select(docs.columns)
