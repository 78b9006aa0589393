"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard, distributed union-find."""

from __future__ import annotations

import random
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, content_key, small, spread_join, stash
from .components import components

#: Characters in a shingle, likeness, bands, rows in a band: a pair at the threshold meets with probability 0.995.
SHINGLE, LIKENESS, BANDS, ROWS = 7, 0.8, 10, 4
#: What is trimmed from lines.
EDGES = " \t\r\x0b\f"
#: Shingles that one generated row hashes.
STRIDE = 8
#: Lines outside a bucket's main component that are held in one row, about.
BLOCK = 32
#: 64-bit words of a set's bitmap.
WORDS = 16
_BYTES = 4  # of a character in UTF-32


def _masks(n: int) -> list[int]:
    rng = random.Random(7)
    return [rng.getrandbits(32) - (1 << 31) for _ in range(n)]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line, a, b) of every line with other than white space; a and b name its trimmed text."""
    rows = docs.select("doc_id", content_key(F.col("text")).alias("text_key"), "text")  # beside the split, each line would hash the whole text
    rows = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    blank = reduce(or_, (F.startswith("line", F.lit(c)) | F.endswith("line", F.lit(c)) for c in EDGES))
    rows = rows.withColumn("line", F.when(blank, F.btrim("line", F.lit(EDGES))).otherwise(F.col("line"))).where("line <> ''")
    return rows.withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64(F.lit(1), "line"))


def _starts(length: Column, shingle: int) -> Column:
    """Where the shingles of a text in UTF-32 start, in bytes from 1; a shorter text is one shingle."""
    return F.sequence(F.lit(1), F.greatest(length - shingle, F.lit(0)) * _BYTES + 1, F.lit(_BYTES))


def _shingle(code: Column, at: Column, shingle: int) -> Column:
    return F.substring(code, at, F.lit(shingle * _BYTES))


def band_keys(lines: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, a, b): a row per band of every distinct line.

    A generated row makes the hashes of STRIDE shingles in a row, all of a line's shingles in
    all; a band's signature is the least hash of them under each of its masks. Equal lines meet
    first, and the minima are taken where they met, so signatures are not shuffled.
    """
    once = lines.groupBy("a", "b").agg(F.first("line").alias("line"))
    code = once.select("a", "b", F.encode("line", "utf-32").alias("code"), F.greatest(F.length("line") - shingle, F.lit(0)).alias("last"))
    cut = code.select("a", "b", "code", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STRIDE))).alias("i"))
    # beyond the line's end the last shingle comes again, which changes no minimum
    at = [F.least(F.col("i") + t, F.col("last")) * _BYTES + 1 for t in range(STRIDE)]
    hashed = cut.select("a", "b", *[F.hash(_shingle(F.col("code"), k, shingle)).alias(f"h{t}") for t, k in enumerate(at)])
    least = [F.min(F.least(*[F.col(f"h{t}").bitwiseXOR(F.lit(m)) for t in range(STRIDE)])).alias(f"m{j}") for j, m in enumerate(_masks(bands * rows))]
    sig = hashed.groupBy("a", "b").agg(*least)
    keys = [F.xxhash64(F.lit(k), *[f"m{j}" for j in range(k * rows, (k + 1) * rows)]) for k in range(bands)]
    return sig.select("a", "b", F.explode(F.array(*keys)).alias("key"))


def bitmaps(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(x, bits, places) of texts (x, line): an array of WORDS longs with one bit for each shingle's hash, and how many shingles there are, repeats counted."""
    code = texts.select("x", F.encode("line", "utf-32").alias("code"), F.greatest(F.length("line") - shingle, F.lit(0)).alias("last"))
    cut = code.select("x", "code", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    hashed = cut.select("x", "last", F.xxhash64(_shingle(F.col("code"), F.col("i") * _BYTES + 1, shingle)).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned("h", 32), F.lit(64)).cast("int"))
    placed = hashed.select("x", "last", F.pmod("h", F.lit(WORDS)).alias("word"), bit.alias("bit"))
    words = placed.groupBy("x", "last").agg(*[F.bit_or(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(WORDS)])
    return words.select("x", F.array(*[f"w{j}" for j in range(WORDS)]).alias("bits"), (F.col("last") + 1).alias("places"))


def _may_be_alike(x: Column, y: Column, sizes: Column, likeness: float) -> Column:
    """False only where the bitmaps differ in more bits than the sets of alike texts differ in shingles; sizes is of both sets."""
    apart = sum((F.bit_count(x[j].bitwiseXOR(y[j])) for j in range(1, WORDS)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return apart * (1 + likeness) <= (1 - likeness) * sizes + 1e-6


def _alike(x: Column, y: Column, likeness: float) -> Column:
    """Whether two sets have the Jaccard likeness, with one intersection (lambdas don't share subexpressions)."""
    return F.size(F.array_intersect(x, y)) * (1 + likeness) >= likeness * (F.size(x) + F.size(y)) - 1e-6


def bucket_members(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, x, a, b, head) of buckets of two lines or more; the head is one of the bucket's lines, drawn by a hash of the bucket.

    Keys are counted apart from the lines, so that no task gathers a bucket.
    """
    found = stash(band_keys(lines_of(docs), shingle, bands, rows), "bands")
    shared = stash(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "buckets")
    many = stash(found.join(small(shared, shared.count(), 5 * BROADCAST_ROWS), "key").withColumn("x", F.concat_ws(":", "a", "b")), "many")
    heads = many.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "x").alias("rank"), "x")).alias("h")).select("key", F.col("h.x").alias("head"))
    return stash(many.join(heads, "key").select("key", "x", "a", "b", "head"), "members")


def similar_lines(docs: DataFrame, likeness: float = LIKENESS, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Returns all lines, and (a, b, root_a, root_b) for every distinct line that is linked to another one.

    Links are pairs that share a band and whose shingle sets have at least the given Jaccard
    likeness. Within a bucket only what union-find needs is compared, in two steps: each line
    with the heads of its buckets; then all other members of a bucket that are still in
    different components, so no link between components is missed.
    """
    members = bucket_members(docs, shingle, bands, rows)
    ids = stash(members.select("a", "b", "x").distinct(), "lines")
    lines = lines_of(docs).join(small(ids, ids.count(), 5 * BROADCAST_ROWS), ["a", "b"], "left")
    lines = stash(lines.select("doc_id", "text_key", "line_no", "a", "b", "x", F.when(F.col("x").isNotNull(), F.col("line")).alias("line")), "occurrences")
    texts = stash(lines.where("x is not null").groupBy("x").agg(F.first("line").alias("line")), "texts")

    bits = stash(bitmaps(texts, shingle), "bits")

    def grams(line: Column) -> Column:
        code = F.encode(line, "utf-32")
        at = _starts(F.length(line), shingle)
        return F.array_distinct(F.get(F.transform(F.array(code), lambda c: F.transform(at, lambda i: F.xxhash64(_shingle(c, i, shingle)))), F.lit(0)))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (x, y) those alike, of which bitmaps rule out most others. Pairs left bring the text of x, and each y has its set made once."""
        near = pairs.join(bits, "x").join(bits.toDF("y", "bits_y", "places_y"), "y")
        near = near.where(_may_be_alike(F.col("bits"), F.col("bits_y"), F.col("places") + F.col("places_y"), likeness))
        near = stash(near.select("x", "y"), "near")
        right = near.select("y").distinct().join(texts.withColumnRenamed("x", "y"), "y").select("y", grams(F.col("line")).alias("sy"))
        both = near.join(texts, "x").join(right, "y")
        # a lambda over the array of one set, so that the set of x is made once a pair
        return both.where(F.exists(F.array(grams(F.col("line"))), lambda sx: _alike(sx, F.col("sy"), likeness))).select("x", "y")

    def root_links(apart: DataFrame) -> DataFrame:
        """Links between the components of a bucket, as pairs of roots.

        Lines outside the bucket's largest component are held in arrays of about BLOCK, and every
        member of the bucket meets each array once: no row per pair, and no pair inside the
        largest component. Bitmaps come first: sets are made only of lines that have a partner
        whose bitmap does not rule it out. A pair with several buckets is compared in the first of them.
        """
        by_root = apart.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        main = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
        main = main.select("key", F.col("most.root").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("blocks"))
        held = apart.join(main, "key").select("key", "x", "root", "blocks", (F.col("root") != F.col("main")).alias("out"))
        keys = apart.groupBy("x").agg(F.collect_list("key").alias("keys"))  # a key per band at most
        own = texts.join(keys, "x")
        held = stash(held.join(own.join(bits, "x"), "x"), "held")
        block = F.pmod(F.xxhash64(F.lit(9), "x"), F.col("blocks")).alias("block")
        thin = held.where("out").groupBy("key", block).agg(F.collect_list(F.struct("x", "root", "bits", "places", "keys")).alias("others"))
        met = held.select("key", "x", "root", "bits", "places", "keys", "out").join(thin, "key").withColumn("o", F.explode("others")).drop("others")
        met = met.where((F.col("o.root") != F.col("root")) & (~F.col("out") | (F.col("x") < F.col("o.x"))))
        met = met.where(_may_be_alike(F.col("bits"), F.col("o.bits"), F.col("places") + F.col("o.places"), likeness))
        met = met.where(F.array_min(F.array_intersect("keys", "o.keys")) == F.col("key"))
        ends = stash(met.select("key", F.explode(F.array("x", "o.x")).alias("x")).distinct(), "ends")
        held = held.join(ends, ["key", "x"], "left_semi")
        outer = held.where("out").withColumn("block", block)
        outer = outer.groupBy("key", "block").agg(F.collect_list(F.struct("x", "root", "keys", "bits", grams(F.col("line")).alias("set"))).alias("others"))
        both = held.join(outer, "key").select("key", "x", "root", "out", "keys", "bits", "others", F.array(grams(F.col("line"))).alias("sets"))

        def near(p: Column, own: Column) -> Column:
            fit = F.least(F.size(own), F.size(p["set"])) >= likeness * F.greatest(F.size(own), F.size(p["set"]))
            fit = fit & _may_be_alike(F.col("bits"), p["bits"], F.size(own) + F.size(p["set"]), likeness)
            first = F.array_min(F.array_intersect("keys", p["keys"])) == F.col("key")
            return (p["root"] != F.col("root")) & (~F.col("out") | (F.col("x") < p["x"])) & fit & first & _alike(own, p["set"], likeness)

        # one lambda over the array of one set, so that the set is made once a row
        linked = F.flatten(F.transform("sets", lambda own: F.transform(F.filter("others", lambda p: near(p, own)), lambda p: p["root"])))
        found = both.select("root", F.explode(F.array_distinct(linked)).alias("other"))
        return found.select(F.least("root", "other").alias("x"), F.greatest("root", "other").alias("y")).distinct()

    tested = members.where("x <> head").select(F.least("x", "head").alias("x"), F.greatest("x", "head").alias("y")).distinct()
    roots = components(stash(verified(stash(tested, "pairs")), "links"), "x", "y")
    # heads have met all members of their buckets, so only the other members are left
    now = members.where("x <> head").join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    apart = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    apart = stash(now.join(apart, "key").select("key", "x", "root"), "apart")
    if not apart.isEmpty():
        joined = components(stash(root_links(apart), "links"), "x", "y").select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        alone = joined.join(roots, F.col("_node") == F.col("node"), "left_anti").select(F.col("_node").alias("node"), F.col("_root").alias("root"))
        roots = roots.join(joined, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root")).union(alone)

    def part(c: str, k: int) -> Column:
        return F.split(c, ":")[k].cast("long")

    return lines.drop("x", "line"), stash(roots.select(part("node", 0).alias("a"), part("node", 1).alias("b"), part("root", 0).alias("root_a"), part("root", 1).alias("root_b")), "classes")


def line_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per line: doc_id, text_key, line_no, keep_doc_id, keep_key, keep_line_no, kept.

    keep_* name the one line of its class that stays: the first by doc_id (null first), text
    and line number. Blank lines are not listed; equal lines are alike whatever their length.
    Null and empty texts have no lines; repeated rows share the decision. No rows: no rows.
    """
    lines, classes = similar_lines(docs, **options)
    n, n_classes = lines.count(), classes.count()
    if n_classes <= BROADCAST_ROWS:
        lines = lines.join(F.broadcast(classes), ["a", "b"], "left")
    else:
        lines = spread_join(lines, classes, ["a", "b"], lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), n)
    lines = lines.select("doc_id", "text_key", "line_no", F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    lines = stash(lines, "rooted")
    place = F.struct("doc_id", "text_key", "line_no")
    first = lines.groupBy("a", "b").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stash(first, "first")
    out = spread_join(lines, first.drop("n"), ["a", "b"], first.select("a", "b", "n"), n)
    out = out.withColumn("keep", F.coalesce("keep", place))
    return out.select("doc_id", "text_key", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.text_key").alias("keep_key"), F.col("keep.line_no").alias("keep_line_no"), place.eqNullSafe(F.col("keep")).alias("kept"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, **options) -> DataFrame:
    """docs with the lines that do not stay taken out of text (blank lines stay); other columns as they are.

    With drop_emptied, documents of which nothing but white space is left go: all they said is
    said elsewhere. Null, empty and blank texts stay either way.
    """
    gone = line_classes(docs, **options).where("not kept").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("_gone"))
    gone = gone.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_k")
    joined = docs.withColumn("_key", content_key(F.col("text"))).join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    joined = joined.withColumn("text", text)
    if drop_emptied:
        joined = joined.where(F.col("_gone").isNull() | F.col("text").rlike(r"\S"))
    return joined.select(*docs.columns)
