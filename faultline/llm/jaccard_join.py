"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Shingles are ordered by how many documents hold them among their first ones, then by hash: common ones stand last. Two
sets that are alike enough share at least l shingles among each one's first n - ceil(t n) + l. Each document takes the
l that makes its estimated cost least: longer prefixes put it into more lists, but every list entry counts for only
one in l of the matches that a candidate needs.

Equal sets are one class. A class's home is the longest list that it is in, or the home of most classes of that list. In each home all classes are compared with
the one whose lists are longest, the hub, so most of a group of thousands of near copies becomes one component without its
pairs. What is left of a long home is compared with all of it in blocks of bounded size, where only links come out;
all other pairs in different components that share enough prefix shingles are compared one by one. No list, pair or
candidate is cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import chunks, free_name, key_type, materialize, spans_to_flat, texts_of, tidy, utf8
from faultline.llm.components import components
from faultline.llm.words import U, Words, mix

#: Shingles whose counts every task knows: at most so many, those found most often, and at least HOT times.
ORDERED, HOT = 1 << 18, 16
#: Longest l, and how many list entries one comparison is worth.
MOST_MATCHES, COMPARISON = 8, 100
#: Bits of the filter of documents whose sets are wanted; it spares work, never rows.
FILTER_BITS = 1 << 23
STEP = 1 << 18
#: Homes of more classes than this are compared in blocks, of about so many classes and shingles a side.
LONG, SIDE, SIDE_SHINGLES = 32, 512, 1 << 18


class Sets:
    """Shingle sets of texts: `tokens` sorted within each, text i from `first[i]` to `first[i + 1]`; `size`, and a key alike for equal sets."""

    def __init__(self, texts: list[bytes], words_each: int):
        words = Words([t.lower() for t in texts])  # bytes: A-Z alone
        token, at = words.runs(words_each)
        owner, counts = words.owner[at], words.counts
        short = np.flatnonzero((counts > 0) & (counts < words_each))
        if len(short):  # the whole sequence as one shingle
            own = []
            for i in short.tolist():
                h = words.hash[words.first[i] : words.first[i + 1]]
                own.append(mix(np.array([sum(int(x) * pow(3, k + 1) for k, x in enumerate(h)) + len(h) & (1 << 64) - 1], U))[0])
            token, owner = np.concatenate([token, np.array(own, U)]), np.concatenate([owner, short])
        order = np.lexsort((token, owner))
        token, owner = token[order], owner[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.tokens, self.owner = token[fresh], owner[fresh]
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)
        total = np.concatenate([np.zeros(1, U), np.cumsum(self.tokens)])
        other = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.tokens ^ U(0x5851F42D4C957F2D)))])
        sums = [t[self.first[1:]] - t[self.first[:-1]] for t in (total, other)]
        self.key = mix(sums[0] * U(0x9E3779B97F4A7C15) + mix(sums[1] + self.size.astype(U))).view(np.int64)


def required(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that any set so like one of `size` shares with it, at least."""
    return -(-percent * size // 100)


def digest() -> Column:
    """Tells the texts of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def describe(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """(doc_id, digest, size, key, heads): each row's hash of its text, set size and class key (null for an empty set), and the
    high halves of the shingles that come first by hash."""

    def run(batches):
        for batch in batches:
            texts, size, key, heads = utf8(batch.column("text")), [], [], []
            for a, b in chunks(texts, STEP):
                s = Sets(texts[a:b], words_each)
                size.append(s.size)
                key += [int(k) if n else None for k, n in zip(s.key, s.size)]
                many = s.size - required(s.size, percent) + (s.size > 0)
                high = (s.tokens >> U(32)).astype("<u4")
                heads += [high[x : x + k].tobytes() for x, k in zip(s.first.tolist(), many.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(np.concatenate(size or [np.zeros(0, np.int64)])), pa.array(key, pa.int64()), pa.array(heads, pa.binary())], ["doc_id", "digest", "size", "key", "heads"])

    plain = texts_of(docs).withColumn("digest", digest())
    return plain.mapInArrow(tidy(run), f"doc_id {key_type(plain)}, digest long, size long, key long, heads binary")


def common_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """High halves of the commonest first shingles, sorted, and how often each was found; ORDERED at most."""

    def run(batches):
        for batch in batches:
            heads = [np.frombuffer(h, "<u4") for h in batch.column("heads").to_pylist() if h]
            token, n = np.unique(np.concatenate(heads), return_counts=True) if heads else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(n)], ["token", "n"])

    counts = described.select("heads").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= HOT).orderBy(F.desc("n"), "token").limit(ORDERED).collect()
    pairs = np.array(sorted((r["token"], r["n"]) for r in rows), np.int64).reshape(-1, 2)
    return pairs[:, 0].astype(np.uint32), pairs[:, 1]


def choose(often: np.ndarray, size: int, least: int) -> int:
    """The l of least cost for a set of `size` with the counts `often` in prefix order: entries met in the lists of the prefix,
    and COMPARISON for every candidate, of whom there are at most 1/l as many as entries."""
    base = size - least
    met = np.cumsum(often[: base + MOST_MATCHES])
    matches = np.arange(1, min(MOST_MATCHES, least) + 1)
    return int(matches[np.argmin(met[base + matches - 1] * (1 + COMPARISON / matches))])


def prefixes(docs: DataFrame, words_each: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, key, size, matches, place): a row for every prefix shingle of every set, by its place; a task enters equal sets once."""
    known, counts = common

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts, STEP):
                s = Sets(texts[a:b], words_each)
                often = np.zeros(len(s.tokens), np.int64)
                if len(known):
                    high = (s.tokens >> U(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(known, high), len(known) - 1)
                    often = np.where(known[at] == high, counts[at], 0)
                order = np.argsort(s.owner * (1 << 40) + np.minimum(often, (1 << 40) - 1), kind="stable")
                token, often, least = s.tokens[order], np.maximum(often[order], 1), required(s.size, percent)
                own, matches = [], []
                for i, key in enumerate(s.key.tolist()):
                    if s.size[i] and key not in seen:
                        seen.add(key)
                        own.append(i)
                        matches.append(choose(often[s.first[i] : s.first[i + 1]], int(s.size[i]), int(least[i])))
                if len(seen) > 1_000_000:
                    seen.clear()
                own, matches = np.array(own, np.int64), np.array(matches, np.int64)
                long = s.size[own] - least[own] + matches
                place = spans_to_flat(np.zeros(len(long), np.int64), long)
                at = np.repeat(s.first[own], long) + place
                columns = [token[at].view(np.int64), *(np.repeat(x, long) for x in (s.key[own], s.size[own].astype(np.int32), matches.astype(np.int8))), place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "key", "size", "matches", "place"])

    return texts_of(docs).select("text").mapInArrow(tidy(run), "token long, key long, size int, matches tinyint, place int")


def sets_of(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """(key, tokens): the sets of the wanted classes, and a few more. Which are wanted every task sees from a bit per
    hash of their keys."""
    bit = wanted.select(F.pmod(F.col("key"), F.lit(FILTER_BITS)).cast("int").alias("bit"))
    words = bit.groupBy(F.expr("bit div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, bit % 32))").alias("bits"))
    filled = np.zeros(FILTER_BITS // 32, np.int64)
    for r in words.collect():  # FILTER_BITS / 32 rows at most
        filled[r["word"]] = r["bits"]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in chunks(texts, STEP):
                s = Sets(texts[a:b], words_each)
                place = s.key % FILTER_BITS
                hit = np.flatnonzero((filled[place // 32] >> place % 32 & 1).astype(bool) & (s.size > 0))
                hit = [i for i in hit.tolist() if not (int(s.key[i]) in seen or seen.add(int(s.key[i])))]
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(s.key[hit]), pa.array([s.tokens[s.first[i] : s.first[i + 1]].view(np.int64) for i in hit], pa.list_(pa.int64()))], ["key", "tokens"])

    return texts_of(docs).select("text").mapInArrow(tidy(run), "key long, tokens array<long>").groupBy("key").agg(F.first("tokens").alias("tokens"))


def verified(docs: DataFrame, pairs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """(a, b): the pairs whose sets are alike enough."""
    sets = sets_of(docs, pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))), words_each)
    left, right = sets.toDF("a", "a_tokens"), sets.toDF("b", "b_tokens")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    alike = 100 * both >= percent * (F.size("a_tokens") + F.size("b_tokens") - both)
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(alike).select("a", "b")


def shared_enough(met: DataFrame, percent: int) -> DataFrame:
    """(a, b): of rows that met on a token (a and b, each with _size, _matches and _place) the pairs that may be alike.

    Two sets so alike share `need` shingles, so at least l among each one's first size - need + l, for the smaller l of the two.
    """
    need = F.ceil(percent * (F.col("a_size") + F.col("b_size")) / (100 + percent))
    matches = F.least("a_matches", "b_matches")
    early = (F.col("a_place") < F.col("a_size") - need + matches) & (F.col("b_place") < F.col("b_size") - need + matches)
    return met.where(early).groupBy("a", "b").agg(F.count("*").alias("n"), F.first(matches).alias("matches")).where("n >= matches").select("a", "b")


def _named(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(name if c == "key" else f"{name}_{c}") for c in rows.columns if c != "token"))


def turned(met: DataFrame) -> DataFrame:
    """`met` with the smaller key as `a`: which of two sets asks may differ by token, and each pair is counted whole."""
    swap = F.col("a") > F.col("b")
    sides = lambda c: (F.col(f"a{c}"), F.col(f"b{c}"))
    columns = [f(*sides(c)).alias(f"{x}{c}") for c in ("", "_size", "_matches", "_place") for x, f in (("a", lambda u, v: F.when(swap, v).otherwise(u)), ("b", lambda u, v: F.when(swap, u).otherwise(v)))]
    return met.select(*columns)


def joining(rows: np.ndarray, columns: np.ndarray, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `alike` that join what its true places join: fewer than there are nodes. `rows` and `columns` are their nodes."""
    parent = list(range(int(max(rows.max(initial=-1), columns.max(initial=-1))) + 1))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for x, node in enumerate(rows.tolist()):
        found = np.flatnonzero(alike[x])
        for y, other in zip(found.tolist(), columns[found].tolist()):
            u, v = root(node), root(other)
            if u != v:
                parent[v] = u
                out.append((x, y))
    at = np.array(out, np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def home_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the labels of each home. `rows` (home, key, size, label, n, shingles, in_largest) are all classes of
    homes of n, with so many shingles together. Those outside the home's largest label are compared with all, a block of either at a time, two
    blocks of such classes once; of a block's links those come out that join labels not yet joined in it, fewer than it has classes."""
    parts = F.greatest(F.ceil(F.col("n") / SIDE), F.ceil(F.col("shingles") / SIDE_SHINGLES)).cast("int")
    share = F.pmod(F.xxhash64("key"), parts).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    left = rows.where("not in_largest").select("home", share.alias("i"), every.alias("j"), F.lit(True).alias("asks"), "key", "size", "label")
    after = F.explode(F.sequence(F.when(F.col("in_largest"), 0).otherwise(share), parts - 1))
    right = rows.select("home", after.alias("i"), share.alias("j"), F.lit(False).alias("asks"), "key", "size", "label")
    asked = left.select("home", "i").distinct()
    blocks = left.unionByName(right.join(asked, ["home", "i"], "left_semi")).join(sets, "key")

    def compare(block):
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        key, size, label = (block.column(c).to_numpy() for c in ("key", "size", "label"))
        tokens = block.column("tokens").combine_chunks()
        owner = np.repeat(np.arange(len(key)), np.diff(tokens.offsets.to_numpy()))
        _, token, often = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
        kept = often[token] > 1
        owner, token = owner[kept], np.unique(token[kept], return_inverse=True)[1]
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        row = np.empty(len(key), np.int64)
        row[a], row[b] = np.arange(len(a)), np.arange(len(b))
        both = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, int(token.max(initial=-1)) + 1, 4096):
            some = (token >= low) & (token < low + 4096)
            sides = []
            for wanted, n in ((True, len(a)), (False, len(b))):
                mine = some & (asks[owner] == wanted)
                m = np.zeros((n, 4096), np.float32)
                m[row[owner[mine]], token[mine] - low] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
        alike = (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)) & (label[a][:, None] != label[b][None, :])
        _, node = np.unique(label, return_inverse=True)
        x, y = joining(node[a], node[b], alike)
        return pa.table({"a": key[a][x], "b": key[b][y]})

    return blocks.groupBy("home", "i", "j").applyInArrow(compare, "a long, b long")


def link(docs: DataFrame, words_each: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(members, labels). `members` (doc_id, digest, size, key) has each row of `docs`; `labels` (key, label) the component of each class that
    has a link. Links join two sets where 100 * intersection >= percent * union.

    Words are runs of anything but space and 0x09 to 0x0D, with A-Z lower-cased. A text of fewer words than a
    shingle is one shingle; null and empty texts have no key and no links. Classes are told apart by 64-bit keys.
    """
    described = materialize(describe(docs, words_each, percent), "sets")
    token = Window.partitionBy("token")
    entries = prefixes(docs, words_each, percent, common_shingles(described))
    ended = entries.withColumns({"first": F.min("key").over(token), "last": F.max("key").over(token)})
    lists = materialize(ended.where("first <> last").drop("first", "last").distinct(), "lists")

    lengths = lists.groupBy("token").agg(F.count("*").alias("n"))
    per_key = lists.join(lengths, "token").groupBy("key").agg(F.max(F.struct("n", F.col("token").alias("home"))).alias("best"), F.avg(F.log("n")).alias("weight"), F.first("size").alias("size"))
    homes = materialize(per_key.select("key", "best.home", "weight", "size"), "first-homes")
    votes = lists.select("token", "key").join(homes.select("key", "home"), "key").groupBy("token", "home").agg(F.count("*").alias("n"))
    moved = votes.groupBy("token").agg(F.max(F.struct("n", "home")).alias("most")).select(F.col("token").alias("home"), F.col("most.home").alias("to"))
    homes = materialize(homes.join(moved, "home").select("key", F.col("to").alias("home"), "weight", "size"), "homes")
    hubs = homes.groupBy("home").agg(F.max(F.struct("weight", "key")).alias("top"), F.count("*").alias("n"), F.sum("size").alias("shingles")).select("home", F.col("top.key").alias("hub"), "n", "shingles")
    homes = homes.join(hubs, "home").select("key", "home", "hub", "size", "n", "shingles")
    asking = lists.join(homes.where("key <> hub").select("key", "hub"), "key")
    told = lists.join(homes.select(F.col("hub").alias("key")).distinct(), "key", "left_semi")
    star = _named(asking, "a").join(_named(told, "b"), ["token"]).where("a_hub = b")
    first = materialize(shared_enough(star, percent), "stars")
    links = materialize(verified(docs, first, words_each, percent), "star-links")
    labels = materialize(components(links), "star-labels")

    at_home = homes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    largest = at_home.groupBy("home", "label").agg(F.count("*").alias("m")).groupBy("home").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels"))
    apart = at_home.where(F.col("n") > LONG).join(largest.where("labels > 1").select("home", F.col("top.label").alias("largest")), "home")
    apart = materialize(apart.select("home", "key", "size", "label", "n", "shingles", (F.col("label") == F.col("largest")).alias("in_largest")), "long-homes")
    links = links.unionByName(home_blocks(apart, sets_of(docs, apart.select("key"), words_each), percent))
    links = materialize(links, "home-links")
    labels = materialize(components(links), "home-labels")

    placed = lists.join(homes.select("key", F.when(F.col("n") > LONG, F.col("home")).alias("home")), "key").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    each = placed.groupBy("token", "label").agg(F.count("*").alias("n"))
    open_lists = each.groupBy("token").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").select("token", F.col("most.label").alias("largest"))
    entered = placed.join(open_lists, "token").withColumn("in_largest", F.col("label") == F.col("largest")).drop("largest")
    entered = materialize(entered, "open-lists")
    met = _named(entered.where("not in_largest"), "a").join(_named(entered, "b"), "token")
    met = met.where("a_label <> b_label and (b_in_largest or a < b) and not coalesce(a_home = b_home, false)").where(100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))
    second = materialize(shared_enough(turned(met), percent), "candidates")
    return described.select("doc_id", "digest", "size", "key"), components(links.unionByName(verified(docs, second, words_each, percent)))


def grouped(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the smallest doc_id of its component, its own where it has no link."""
    placed = materialize(members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")), "members")
    smallest = placed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "label", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words_each: int = 4, percent: int = 85) -> DataFrame:
    """`docs`, all columns, with one document of each component: the one with the smallest doc_id, and of texts that repeat it
    the one with the smallest hash. A doc_id with two texts is two documents. Of rows that repeat doc_id and
    text one stays. A row without doc_id cannot be named as the one to go, so it stays; so does one without shingles."""
    members, labels = link(docs, words_each, percent)
    placed = members.where("doc_id is not null and key is not null").join(labels, "key", "left").select("doc_id", "digest", F.coalesce("label", "key").alias("label"))
    placed = materialize(placed, "documents")
    first = placed.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    gone = placed.join(first, "label").where(F.struct("doc_id", "digest") != F.col("first")).select(F.col("doc_id").alias(free_name("gone", docs.columns)), F.col("digest").alias(free_name("digest", docs.columns))).distinct()
    key, hashed = gone.columns
    kept = docs.join(gone, (docs["doc_id"] == gone[key]) & (digest() == gone[hashed]), "left_anti")
    repeated = members.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").distinct()
    if repeated.isEmpty():
        return kept
    name, place = free_name("again", docs.columns), free_name("place", docs.columns)
    again = repeated.select(F.col("doc_id").alias(name))
    same = kept["doc_id"].eqNullSafe(again[name])
    rows = Window.partitionBy("doc_id", "text").orderBy(F.monotonically_increasing_id())
    first = kept.join(again, same, "left_semi").withColumn(place, F.row_number().over(rows)).where(F.col(place) == 1).drop(place)
    return kept.join(again, same, "left_anti").unionByName(first)
