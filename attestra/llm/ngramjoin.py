"""N-gram Jaccard join: an LSH forest of MinHash signatures, whose prefixes are shortened as the links found ask for, and exact verification in blocks."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, small, stash
from .components import components

#: Words in a shingle, likeness, trees, signature values in a tree, recall to reach at the threshold.
SHINGLE, LIKENESS, TREES, DEPTH, RECALL = 5, 0.8, 20, 8, 0.999
#: Texts and bytes of shingle hashes in a block of a bucket.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20

_hashes: dict[str, int] = {}


def meeting(likeness: float, length: int, trees: int = TREES) -> float:
    """The probability that two texts share a prefix of the length in some tree."""
    return 1 - (1 - likeness**length) ** trees


def least_length(likeness: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which even pairs at the threshold meet often enough: no shorter one is ever needed."""
    d = depth
    while d > 1 and meeting(likeness, d, trees) < recall:
        d -= 1
    return d


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingle_hashes(words: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of shingle words, in order; fewer words are one shingle, none have none."""
    import xxhash

    if len(_hashes) > 300_000:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(shingle, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s = (s ^ h[j : len(h) - n + 1 + j]) * np.uint64(0x9FB21C651E98DF25)
        s ^= s >> np.uint64(32)
    return s


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of the upper half of the shingles' hashes times each factor."""
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * factors).min(axis=0), out=least)
    return least


def factors(trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """Odd numbers: each permutes the hashes in its own way, where XOR masks over one hash would depend on each other."""
    return np.random.default_rng(3).integers(0, 1 << 32, trees * depth, np.uint32) | np.uint32(1)


def shared_lengths(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How long a prefix each signature (texts, trees, depth) shares with one in each tree."""
    return np.logical_and.accumulate(sigs == one, axis=2).sum(axis=2)


def compare_block(left: np.ndarray, right: np.ndarray | None, sigs: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, tree: int, length: int, likeness: float):
    """Links within left, or between left and right (row numbers): counts per row, a spanning forest, and the links to expect.

    A pair counts in the first tree whose prefix of the length both share, and not at all if
    they share a longer one in any tree: then it was compared before. The last result is, for
    each length, the sum over the links, each once, of 1 / the probability to meet at it.
    """
    n, depth = len(sets), sigs.shape[2]
    texts, docs, parent, expected = np.zeros(n, np.int64), np.zeros(n, np.int64), list(range(n)), np.zeros((n, depth))
    sizes = np.array([len(s) for s in sets])

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for pos, i in enumerate(left):
        others = left[pos + 1 :] if right is None else right
        others = others[np.minimum(sizes[others], sizes[i]) >= likeness * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        shared = shared_lengths(sigs[others], sigs[i])
        new = (shared[:, tree] >= length) & ~(shared[:, :tree] >= length).any(axis=1) & ~(shared > length).any(axis=1)
        for j in others[new]:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= likeness * (sizes[i] + sizes[j] - both) - 1e-9:
                texts[i] += 1
                texts[j] += 1
                docs[i] += copies[j]
                docs[j] += copies[i]
                alike = both / (sizes[i] + sizes[j] - both)
                expected[i] += [1 / meeting(alike, d, sigs.shape[1]) for d in range(1, depth + 1)]
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return texts, docs, [top(i) for i in range(n)], expected


def link_documents(docs: DataFrame, likeness: float = LIKENESS, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, n_links, n_text_links, n_copies.

    Two documents are linked when their sets of shingle-word runs (lower-cased words by white
    space; fewer words are one run) have at least the given Jaccard likeness. class_id is the
    least doc_id of the connected component; n_links counts linked documents, n_text_links
    linked texts that differ in words, n_copies other documents with the same words. Texts
    with the same words are one node throughout. Documents without words and null texts link
    with nothing. Repeated rows are copies of each other. An empty table gives no rows.
    """
    return link_rows(docs, likeness, shingle, trees, depth, recall).drop("one_id", "one_key")


def link_rows(docs: DataFrame, likeness: float = LIKENESS, shingle: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """link_documents with (one_id, one_key): doc_id and text_key of the one document that stands for the component.

    It is the least by doc_id, null last, then text_key; both are null for documents without words.

    Each text has a signature of depth values in each of the trees: its path in a trie. Texts
    that share a path of full depth are compared first; then, level by level, those that share
    a shorter one and no longer one. How many links a level has missed is estimated from the
    likeness of those found, each standing for 1 / its probability to meet so deep; when those
    found reach the target recall, no shorter prefixes are tried. While nothing has been found,
    nothing is known of what is missed, and all prefixes down to the shortest are tried.
    """
    least, m = least_length(likeness, trees, depth, recall), factors(trees, depth)

    def sign(batches):
        import pyarrow as pa

        for b in batches:
            nodes, keys, sizes = [], [], []
            for text in b.column(2).to_pylist():
                w = words_of(text)
                if not w:
                    nodes.append(None)
                    keys.append(None)
                    sizes.append(0)
                    continue
                s = shingle_hashes(w, shingle)
                nodes.append(hashlib.md5(" ".join(w).encode("utf-8", "surrogatepass")).hexdigest())
                keys.append(signature(s, m).tobytes())
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.string()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "text_key", "node", "keys", "n_shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key(F.col("text")).alias("text_key"), "text")
    signed = stash(rows.mapInArrow(sign, "doc_id long, text_key long, node string, keys binary, n_shingles long"), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "text_key")).alias("first"))
    nodes = stash(nodes, "nodes")
    one = signed.where("node is not null").groupBy("node").agg(F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles"))
    one = stash(one, "one")

    def buckets(length: int) -> tuple[DataFrame, DataFrame]:
        """The (bucket, tree, node) of all texts, and the buckets of two texts or more. Of buckets of the same texts, that of the first tree stands for all."""
        paths = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring(F.col("keys"), t * (4 * depth) + 1, F.lit(4 * length))).alias("bucket")))
        entries = one.select("node", "n_shingles", F.explode(paths).alias("e")).select("e.tree", "e.bucket", "node", "n_shingles")
        counted = entries.groupBy("bucket", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"), F.bit_xor(F.xxhash64("node")).alias("who"), F.bit_xor(F.xxhash64(F.lit(5), "node")).alias("who2")).where("n > 1")
        counted = counted.groupBy("n", "who", "who2").agg(F.min(F.struct("tree", "bucket", "total")).alias("b")).select("b.tree", "b.bucket", "b.total", "n", "who", "who2")
        counted = counted.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") * 8 / BLOCK_BYTES)).cast("int"))
        return entries.drop("n_shingles", "tree"), stash(counted, "buckets")

    entries, counted = buckets(least)
    known_buckets = {least: (entries, counted)}
    # texts that meet no other at the shortest prefix meet none at a longer one
    wanted = entries.join(counted.select("bucket"), "bucket").select("node").distinct().join(nodes.select("node", "copies", "one"), "node").join(one.select("node", "keys"), "node")
    wanted = stash(wanted, "wanted")
    n_wanted = wanted.count()

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                w = words_of(text)
                s = shingle_hashes(w, shingle)
                found.append((hashlib.md5(" ".join(w).encode("utf-8", "surrogatepass")).hexdigest(), np.unique(s).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["node", "set"])

    keys = wanted.select(F.col("one.doc_id").alias("_d"), F.col("one.text_key").alias("_k"))
    texts = rows.join(small(keys, n_wanted), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left_semi").select("text")
    known = texts.mapInArrow(sets, "node string, set binary").dropDuplicates(["node"])
    known = stash(known.join(wanted.select("node", "copies", "keys"), "node"), "sets")

    def compare_at(length: int):
        def compare(table):
            import pyarrow as pa

            block_of = np.array(table.column("block").to_pylist())
            lo, hi, tree = table.column("lo")[0].as_py(), table.column("hi")[0].as_py(), table.column("tree")[0].as_py()
            name = table.column("node").to_pylist()
            sigs = np.stack([np.frombuffer(k.as_py(), np.uint32) for k in table.column("keys")]).reshape(len(name), trees, depth)
            found = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("set")]
            copies = np.array(table.column("copies").to_pylist(), np.int64)
            at = np.arange(len(name))
            left, right = at[block_of == lo], None if lo == hi else at[block_of == hi]
            texts, docs_, root, expected = compare_block(left, right, sigs, found, copies, tree, length, likeness)
            hit = np.flatnonzero(texts)
            return pa.table({"node": pa.array([name[i] for i in hit], pa.string()), "root": pa.array([name[root[i]] for i in hit], pa.string()), "texts": pa.array(texts[hit]), "links": pa.array(docs_[hit]), "expected": pa.array([list(e) for e in expected[hit]], pa.list_(pa.float64()))})

        return compare

    levels, done, met, to_expect = [], None, 0, [0.0] * depth
    for length in range(depth, least - 1, -1):
        entries, counted = known_buckets.get(length) or buckets(length)
        if done is not None:  # the same texts met at a longer prefix: all their pairs have been compared
            counted = counted.join(done, ["n", "who", "who2"], "left_anti")
        members = entries.join(counted.drop("who", "who2", "total", "n"), "bucket").withColumn("block", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("blocks")).cast("int"))
        spread = members.select("bucket", "tree", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        spread = spread.select("bucket", "tree", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        found = spread.join(known, "node").groupBy("bucket", "lo", "hi").applyInArrow(compare_at(length), "node string, root string, texts long, links long, expected array<double>")
        levels.append(stash(found, "links"))
        row = levels[-1].agg(F.sum("texts"), *[F.sum(F.get("expected", F.lit(k))) for k in range(depth)]).first()
        met, to_expect = met + (row[0] or 0) / 2, [x + (y or 0.0) for x, y in zip(to_expect, row[1:], strict=True)]
        if met and met >= recall * to_expect[length - 1]:
            break
        done = counted.select("n", "who", "who2") if done is None else done.union(counted.select("n", "who", "who2"))
    links = levels[0]
    for more in levels[1:]:
        links = links.union(more)
    roots = components(links.where("node <> root").select("node", "root"), "node", "root")
    per = links.groupBy("node").agg(F.sum("texts").alias("n_text_links"), F.sum("links").alias("n_links"))
    info = nodes.join(per, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = info.where("n_text_links is not null").groupBy("root").agg(F.min("first_id").alias("least_id"), F.min("first").alias("least"))
    info = info.join(least, "root", "left").select("node", F.coalesce("least_id", "first_id").alias("class_id"), F.coalesce("least", "first").alias("stands"), (F.col("copies") - 1).alias("n_copies"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("doc_id", "text_key", "node").join(info, "node", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("n_links", zero) + F.coalesce("n_copies", zero)).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links"), F.coalesce("n_copies", zero).alias("n_copies"), F.col("stands.doc_id").alias("one_id"), F.col("stands.text_key").alias("one_key"))
