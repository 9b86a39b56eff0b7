"""N-gram Jaccard self-join by grouped prefixes, JVM side only.

A document is the set of its distinct 5-word shingles. In an order of shingles that puts frequent ones
last, two sets with Jaccard similarity of at least t share one of the first n - ceil(t n) + 1. Documents
with identical prefixes and size collapse into one group; groups that share a prefix element and pass
the length and count filters (what two sets share stands in both prefixes or behind the one that ends
first) are candidate group pairs; these expand to classes of identical sets, which are verified by
intersection. Copies count as members of a class and are never paired.

The order: shingles fall in BUCKETS buckets by hash, counted over all documents; less loaded buckets
come first. Any order gives the same result; this one keeps passages that many documents share out of
the prefixes, so no prefix element has a list that grows with such a passage. The loads reach the
tasks as a literal of one byte a bucket (64 kB, whatever the corpus), its level on a log scale.

Sets are compared by 64-bit hashes. Components come from alternating large-star and small-star rounds
over the links between classes, each written to the shared folder.

Defined cases: null and empty texts have the empty set: n_shingles 0, n_similar 0, a component of their
own; fewer than five words are one shingle; rows of one id are one document (repeated rows give repeated
result rows); a null id has its own n_shingles and no links; an empty table gives an empty result; other
input columns aren't read. No pair is capped: a group of k different, similar sets costs k^2 / 2 links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import LOWER, UPPER, whole, words, written

SIZE, BUCKETS = 5, 1 << 16
_HASH_BITS = 48


def shingled(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """`keep` and the array of the distinct shingle hashes as `_s`."""
    names = [F.col(f"`{c}`") for c in docs.select(*keep).columns]
    a = docs.select(*keep, words(F.translate(whole(text), UPPER, LOWER)).alias("_w"))
    b = a.select(*names, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    n = F.size("_h")
    each = F.transform(F.sequence(F.lit(0), n - SIZE), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(SIZE)]))
    one = F.when(n > 0, F.array(F.xxhash64(n, "_h"))).otherwise(F.array().cast("array<bigint>"))
    return b.select(*names, F.array_distinct(F.when(n >= SIZE, each).otherwise(one)).alias("_s"))


def bucket_levels(sets: DataFrame, buckets: int) -> bytearray:
    """For each bucket the level, 1 to 127, of its share of all set elements: 64 is the mean, a step 3 %."""
    # an outer explode: the inner one would infer a filter that computes every set a second time
    counts = sets.select(F.explode_outer("_s").alias("h")).filter(F.col("h").isNotNull()).groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("b")).count()
    full = sets.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("count", F.lit(0)).alias("n"))
    row = full.agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("x"), F.avg("n").alias("mean"))
    level = F.transform("x", lambda x: F.when(x["n"] == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(127), (64 + F.ln(x["n"] / F.col("mean")) / 0.03).cast("int")))))
    return row.select(F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""))).first()[0]


def signatures(docs: DataFrame, id_col: str, text: str, numerator: int, denominator: int, buckets: int) -> DataFrame:
    """Per row: id, n (set size), c1 and c2 (class: identical sets), g (group: identical prefix and size) and the prefix."""
    sets = shingled(docs, F.col(f"`{text}`"), [F.col(f"`{id_col}`").alias("_id")])
    levels = F.lit(bytearray(bucket_levels(sets, buckets)))
    level = lambda h: F.ascii(F.substring(levels, F.pmod(h, F.lit(buckets)).cast("int") + 1, F.lit(1)).cast("string")).cast("bigint")
    keys = F.transform("_s", lambda h: F.shiftleft(level(h), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS)))
    n = F.size("_s")
    a = sets.select("_id", n.alias("n"), F.sort_array("_s").alias("_o"), keys.alias("_k"))
    short = F.col("n") - F.expr(f"(n * {numerator} + {denominator - 1}) div {denominator}").cast("int") + 1
    b = a.select("_id", "n", F.xxhash64("_o").alias("c1"), F.hash("_o").alias("c2"), F.slice(F.sort_array("_k"), 1, F.greatest(short, F.lit(0))).alias("prefix"))
    return b.select("_id", "n", "c1", "c2", F.xxhash64("n", "prefix").alias("g"), F.when(F.col("n") > 0, F.col("prefix")).alias("prefix"))


def candidates(sig: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(classes, candidate class pairs a, b): every similar pair of different sets is among them once."""
    some = sig.filter((F.col("n") > 0) & F.col("_id").isNotNull())
    classes = some.select("_id", "n", "c1", "c2", "g").distinct().groupBy("c1", "c2", "n", "g").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    named = some.groupBy("g", "n").agg(F.min("_id").alias("gid"))  # short names: they are what the elements carry
    classes = written(classes.join(named, ["g", "n"]), "jaccard-classes")
    groups = some.groupBy("g", "n").agg(F.any_value("prefix").alias("prefix"), F.min("_id").alias("gid"))
    x = groups.select("gid", "n", F.explode("prefix").alias("e"))
    a, b = x.alias("a"), x.alias("b")
    t, u = numerator, denominator
    smaller = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.gid") < F.col("b.gid")))
    pairs = a.join(b, (F.col("a.e") == F.col("b.e")) & smaller & (u * F.col("a.n") >= t * F.col("b.n")))
    pairs = pairs.groupBy(F.col("a.gid").alias("ga"), F.col("a.n").alias("na"), F.col("b.gid").alias("gb"), F.col("b.n").alias("nb")).agg(F.count(F.lit(1)).alias("k"))
    # What two sets share is in both prefixes (k elements) or behind the prefix that ends first
    behind = F.expr(f"(nb * {t} + {u - 1}) div {u}") - 1
    pairs = pairs.filter((t + u) * (F.col("k") + behind) >= t * (F.col("na") + F.col("nb"))).drop("k")
    ca = classes.select(F.col("gid").alias("ga"), F.col("n").alias("na"), F.struct("rep", "n", "c1", "c2").alias("a"))
    cb = classes.select(F.col("gid").alias("gb"), F.col("n").alias("nb"), F.struct("rep", "n", "c1", "c2").alias("b"))
    across = pairs.join(ca, ["ga", "na"]).join(cb, ["gb", "nb"]).select("a", "b")
    within = ca.join(cb, (F.col("ga") == F.col("gb")) & (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))).select("a", "b")
    return classes, written(across.unionAll(within), "jaccard-pairs")


def _flags(keys: DataFrame, most: int = 1 << 18) -> tuple[bytearray, int]:
    """For each bucket of a hash of the ids whether one of them falls in it: a byte a bucket, eight buckets an id, at most `most`."""
    n = keys.count()
    buckets = min(most, 1 << max(10, (8 * n).bit_length()))
    hit = keys.select(F.pmod(F.xxhash64("_id"), F.lit(buckets)).alias("id")).distinct().withColumn("f", F.lit("01"))
    every = keys.sparkSession.range(buckets).join(hit, "id", "left").select("id", F.coalesce("f", F.lit("00")).alias("f"))
    part = every.groupBy(F.floor(F.col("id") / 4096).alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "f"))), lambda x: x["f"]), "").alias("t"))
    row = part.agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), ""))).first()
    return bytearray(row[0]), buckets


def _sets_of(docs: DataFrame, id_col: str, text: str, asked: DataFrame) -> DataFrame:
    """The columns of `asked` (classes c, each once) and the sorted set of each as `_s`, made again from the texts.

    Texts that nobody asks for are left out before the shuffle by a filter of hash buckets (it saturates
    beyond 100,000 asked classes: then more texts move, with the same result).
    """
    flags, buckets = _flags(asked.select(F.col("c.rep").alias("_id")))
    flagged = F.ascii(F.substring(F.lit(flags), F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int") + 1, F.lit(1)).cast("string")) == 1
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_t")).filter(flagged)
    found = texts.join(asked.withColumn("_id", F.col("c.rep")), "_id").dropDuplicates(["_id", "c", "_t"])  # repeated rows are one document
    sets = shingled(found, F.col("_t"), [F.col(c) for c in asked.columns])
    sets = sets.select(*asked.columns, F.sort_array("_s").alias("_s"))
    mine = (F.xxhash64("_s") == F.col("c.c1")) & (F.hash("_s") == F.col("c.c2")) & (F.size("_s") == F.col("c.n"))  # of an id with two texts
    return sets.withColumn("_p", F.spark_partition_id()).filter((F.col("_p") >= 0) & mine).drop("_p")


def verified(docs: DataFrame, id_col: str, text: str, pairs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The candidate pairs (a, b) that are similar.

    A class isn't compared by its whole set but by its difference from that of its hub, the least class
    that it is paired with: |A + B| = |dA| + |dB| - 2 |dA & dB| (symmetric differences) for differences
    from one hub, so a pair carries the few elements in which near copies differ and each set moves
    once. Pairs with two hubs are compared by whole sets.
    """
    t, u = numerator, denominator
    ends = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hubs = ends.groupBy(F.col("a").alias("c")).agg(F.min(F.least("a", "b")).alias("hub"))
    heads = hubs.select(F.col("hub").alias("c")).distinct().withColumn("head", F.lit(True))
    asked = written(hubs.join(heads, "c", "left").withColumn("head", F.coalesce("head", F.lit(False))), "jaccard-asked")
    sets = _sets_of(docs, id_col, text, asked)
    near = sets.select("c", "hub", "_s").join(sets.filter("head").select(F.col("c").alias("hub"), F.col("_s").alias("h")), "hub")
    apart = near.select("c", "hub", F.concat(F.array_except("_s", "h"), F.array_except("h", "_s")).alias("d"))
    d = written(apart, "jaccard-differences")
    two = pairs.join(d.select(F.col("c").alias("b"), F.col("hub").alias("hb"), F.col("d").alias("db")), "b").join(d.select(F.col("c").alias("a"), F.col("hub").alias("ha"), F.col("d").alias("da")), "a")
    differ = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    both = F.col("a.n") + F.col("b.n")
    judged = written(two.select("a", "b", F.when(F.col("ha") == F.col("hb"), (t + u) * (both - differ) >= 2 * t * both).alias("similar")), "jaccard-judged")
    rest = judged.filter("similar IS NULL").select("a", "b")
    left = written(rest.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "jaccard-rest")
    s = _sets_of(docs, id_col, text, left)
    whole_sets = rest.join(s.select(F.col("c").alias("b"), F.col("_s").alias("sb")), "b").join(s.select(F.col("c").alias("a"), F.col("_s").alias("sa")), "a")
    other = whole_sets.filter((t + u) * F.size(F.array_intersect("sa", "sb")) >= t * (F.col("a.n") + F.col("b.n"))).select("a", "b")
    return judged.filter("similar").select("a", "b").unionAll(other)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes of undirected edges (x, y)."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0))).first())

    e = written(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x != y").distinct(), "jaccard-edges")
    last = state(e)
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
        big = both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").distinct()
        least = big.groupBy("x").agg(F.min("y").alias("m"))
        small = big.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").unionAll(least.select("x", F.col("m").alias("y"))).distinct()
        e = written(small, "jaccard-edges")
        now = state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = e.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return stars.unionAll(e.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", numerator: int = 4, denominator: int = 5, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: id, n_shingles, n_similar (other documents with a similarity of at least
    numerator / denominator) and component_id (the smallest id reachable over such links)."""
    if not 0 < numerator <= denominator:
        raise ValueError("the threshold must be above 0 and at most 1")
    sig = written(signatures(docs, id_col, text, numerator, denominator, buckets), "jaccard-signatures")
    classes, pairs = candidates(sig, numerator, denominator)
    links = written(verified(docs, id_col, text, pairs, numerator, denominator), "jaccard-links")
    key = ["c1", "c2", "n"]
    ends = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.struct("rep", "n", "c1", "c2").alias("b"), "members")
    linked = ends.join(sizes, "b").groupBy("a").agg(F.sum("members").alias("others")).select("a.c1", "a.c2", "a.n", "others")
    parts = components(links.select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y"))).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    info = classes.join(linked, key, "left").join(parts, "rep", "left")
    info = info.select(*key, (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("similar"), F.coalesce("part", "rep").alias("part"))
    out = sig.select("_id", *key).join(info, key, "left")
    own = F.col("_id").isNotNull()
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.when(own, F.coalesce("similar", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_similar"), F.when(own, F.coalesce("part", "_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", numerator: int = 4, denominator: int = 5) -> DataFrame:
    """The input's rows and columns of one document, that with the smallest id, of each group of similar ones."""
    found = similar_documents(docs, id_col, text, numerator, denominator)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
