"""Document fingerprints from spot signatures (SpotSigs): an anchor with the chain of content words that follow it. DataFrame
functions only.

Anchors are the very common words, each where a content word follows, the content words whose hash is a multiple of EVERY, so
that texts without common words (lists, tables, short notes) have anchors too, and the start of the text, so that every text
with a word has a signature.
A fingerprint is the sorted set of its signatures' 32-bit hashes in hexadecimal. Two are compared by Jaccard; sets
whose lengths rule out the wanted likeness are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize

#: Common words of English, German, French and Spanish.
ANCHORS = "the of and is to der die das und ist le la les de et el los las y que".split()
#: A content word in so many, by hash, is an anchor.
EVERY = 8
START = "^"
_LETTER, _GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"
_COMMON = rf"(?:{'|'.join(ANCHORS)})(?!{_LETTER})"
#: A content word (group 2) with the common word just before it, if there is one (group 1).
CONTENT = rf"(?<!{_LETTER})(?:({_COMMON}){_GAP})?(?!{_COMMON})({_LETTER}++)"
_SCRATCH = ("_spot_text", "_spot_common", "_spot_word", "_spot_chains")


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with the sorted set of the signatures of column `text`: for each anchor, the hash of it and the next two content words, or of
    as many as the text still has. A text of common words alone is one chain; a text without words has no signatures. Letters
    count in lower case. Names in _SCRATCH are taken; the steps are columns, so that none is worked out twice."""
    small, common, word, chains = _SCRATCH
    df = df.withColumn(small, F.lower(text))
    df = df.withColumns({common: F.regexp_extract_all(small, F.lit(CONTENT), F.lit(1)), word: F.regexp_extract_all(small, F.lit(CONTENT), F.lit(2))})
    following = F.slice(word, F.lit(2), F.greatest(F.size(word), F.lit(1)))
    before = F.concat(F.array(F.lit(START)), F.slice(word, F.lit(1), F.greatest(F.size(word) - 1, F.lit(0))))
    zipped = F.arrays_zip(F.col(common).alias("common"), F.col(word).alias("word"), following.alias("next"), before.alias("last"))
    df = df.withColumn(chains, F.when(F.size(word) > 0, zipped))
    by_common = F.transform(F.filter(chains, lambda c: c["common"] != ""), lambda c: F.hash(c["common"], c["word"], c["next"]))
    own = lambda c: (F.pmod(F.hash(c["last"]), F.lit(EVERY)) == 0) | (c["last"] == START)
    by_hash = F.transform(F.filter(chains, own), lambda c: F.hash(c["last"], c["word"], c["next"]))
    alone = F.when(F.col(small).rlike(_LETTER), F.array(F.hash(F.lit(START), F.regexp_replace(small, _GAP, " "))))
    found = F.array_sort(F.array_distinct(F.concat(by_common, by_hash)))
    return df.withColumn(out, F.coalesce(found, alone, F.array().cast("array<int>"))).drop(*_SCRATCH)


def fingerprint(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets, two empty ones alike; 0 without a comparison where their lengths rule out `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when(small < least * large, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, next_id, next_h): for each document, by key and hash of its text, the one after it in ascending order
    of both; after the last comes the first. Only keys and lengths move, in ranges; each range's last document looks up
    the next range's first."""
    ids = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct()
    ranged = materialize(ids.repartitionByRange("doc_id", "h").withColumn("part", F.spark_partition_id()), "ranges")
    key = F.struct("doc_id", "h")
    firsts = ranged.groupBy("part").agg(F.min(key).alias("first"))
    parts = Window.orderBy("part")  # a row for each range
    borders = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = Window.partitionBy("part").orderBy("doc_id", "h")
    led = ranged.withColumn("next", F.lead(key).over(inside)).join(F.broadcast(borders), "part")
    after = F.coalesce("next", "after")
    return led.select("doc_id", "h", "n", after["doc_id"].alias("next_id"), after["h"].alias("next_h"))


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, marks, next_marks): each document with the edited text that its successor gives, and the
    signatures of both documents. `edited` has the last quarter of the code points, rounded down, replaced by the first as
    many of the successor, or all of it.

    A null text is empty. Rows that repeat key and text are one document to the order, and each gets its row. A
    document alone is its own successor. Texts are dealt out once, by key and hash, for both joins; a successor sends the
    head that is asked of it and its signatures, which are made after that exchange.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = plain.select("doc_id", F.xxhash64("text").alias("h"), "text")
    links = successors(plain)
    givers = links.select(F.col("next_id").alias("asked_id"), F.col("next_h").alias("asked_h"), F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    same = lambda x, y: F.col("doc_id").eqNullSafe(F.col(x)) & (F.col("h") == F.col(y))
    given = with_signatures(base.join(givers.hint("shuffle_hash"), same("asked_id", "asked_h")), "text", "next_marks").select("to_id", "to_h", F.substring("text", F.lit(1), F.col("k")).alias("head"), "next_marks")
    given = given.groupBy("to_id", "to_h").agg(F.first("head").alias("head"), F.first("next_marks").alias("next_marks"))
    kept = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    edited = base.join(given, same("to_id", "to_h")).select("doc_id", "text", F.concat(F.substring("text", F.lit(1), kept), "head").alias("edited"), "next_marks")
    return with_signatures(edited, "text", "marks").select("doc_id", "text", "edited", "marks", "next_marks")


def near_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs) of near-duplicate documents: `classes` (doc_id, fingerprint) for each row, `pairs` (a, b, near) of different
    fingerprints, a < b, that are alike by `least` or more. Sets without signatures pair with nothing.

    A set's rarest signatures, as many as may all be missing from a set so like it and one more, are looked up
    among the same of sets whose lengths are near enough; lengths that far apart fall in parts that do not meet.
    """
    classes = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "marks").withColumn("fingerprint", fingerprint(F.col("marks")))
    sets = classes.groupBy("fingerprint").agg(F.first("marks").alias("marks")).where(F.size("marks") > 0)
    each = sets.select("fingerprint", F.explode("marks").alias("mark"), F.size("marks").alias("size"))
    often = each.groupBy("mark").agg(F.count("*").alias("often")).where("often > 1")
    rare = Window.partitionBy("fingerprint").orderBy("often", "mark")
    ranked = each.join(often, "mark", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("place", F.row_number().over(rare))
    prefix = ranked.where(F.col("place") <= F.col("size") - F.ceil(least * F.col("size")) + 1).where("often > 1").select("fingerprint", "mark", "size")
    level = F.floor(F.log(F.col("size")) / math.log(1 / least) + 1e-9)
    left = prefix.select(F.col("fingerprint").alias("a"), "mark", F.col("size").alias("a_size"), level.alias("level"))
    right = prefix.select(F.col("fingerprint").alias("b"), "mark", F.col("size").alias("b_size"), F.explode(F.array(level, level + 1, level - 1)).alias("level"))
    close = (F.col("a") < F.col("b")) & (F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size"))
    pairs = left.join(right, ["mark", "level"]).where(close).select("a", "b").distinct()
    marks = lambda x: sets.select(F.col("fingerprint").alias(x), F.col("marks").alias(f"{x}_marks"))
    near = likeness(F.col("a_marks"), F.col("b_marks"), least)
    found = pairs.join(marks("a"), "a").join(marks("b"), "b").select("a", "b", near.alias("near")).where(F.col("near") >= least)
    return classes.select("doc_id", "fingerprint"), found
