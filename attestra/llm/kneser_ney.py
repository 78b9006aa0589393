"""Interpolated modified Kneser-Ney model of any order from two, counted by Spark, kept as sorted arrays that workers map into memory."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from itertools import chain, compress, islice
from urllib.parse import unquote, urlsplit

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stash

#: Tokens or distinct n-grams in a shard of the model.
SHARD_ROWS = 2_000_000
#: Bytes of text, and n-grams, that a task has in memory at a time.
PIECE_BYTES, HELD_GRAMS = 4 << 20, 2_000_000
#: Words whose identifiers a task keeps between pieces, about.
KEPT_WORDS = 120_000
#: A token no text holds, as words have no white space.
END = b"\n"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words by ASCII white space with A-Z lowered, then the end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def first_tokens(text: bytes | None, most: int) -> list[bytes]:
    """The first most of a text's tokens, without cutting what follows them."""
    words = [w.lower() for w in (text or b"").split(None, most)[:most]]
    return words if len(words) == most else [*words, END]


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def mix(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint64) * _MIX
    return v ^ (v >> np.uint64(31))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, differences of the first, byte by byte and compressed."""
    import zstandard

    first = np.diff(arrays[0], prepend=arrays[0][:1] * 0)
    packed = [np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for a in (first, *arrays[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(packed))


def expand(blob: bytes, width: int) -> list[np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(flat) // (4 * width)
    out = [np.ascontiguousarray(flat[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T).view(np.uint32).reshape(n) for k in range(width)]
    return [np.cumsum(out[0], dtype=np.uint64).astype(np.uint32), *out[1:]]


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_arrays(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Each array as a file of its own, under another name until it is whole, so that a task may run again."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    for key, a in arrays.items():
        spare = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(spare) as out:
            out.write(np.ascontiguousarray(a).tobytes())
        store.move(spare, f"{root}/{name}.{key}")


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that fit in a row."""

    folder: str
    vocab_sizes: tuple  # of the shards of the vocabulary
    shards: int  # of each level of n-grams
    tokens: int
    docs: int
    hot: tuple  # identifiers of frequent words; contexts of such words only are dealt by the last word too
    discounts: tuple  # of the words, then of each level from pairs on
    types: int  # distinct pairs
    word_gamma: float
    order: int

    @property
    def vocab(self) -> int:
        return sum(self.vocab_sizes)


class Arrays:
    """A worker's memory maps of a model; a store that cannot be mapped is copied to the worker's disk once."""

    def __init__(self, model: Model):
        self.m = model
        self.base = np.concatenate([[0], np.cumsum(model.vocab_sizes)]).astype(np.int64)
        parts = urlsplit(model.folder)
        if parts.scheme in ("", "file"):
            self.root = unquote(parts.path)
        else:
            self.root = tempfile.mkdtemp()
            store, root = _store(model.folder)
            from pyarrow import fs

            for f in store.get_file_info(fs.FileSelector(root)):
                with store.open_input_stream(f.path) as src, open(f"{self.root}/{f.base_name}", "wb") as dst:
                    shutil.copyfileobj(src, dst)
        self.maps: dict[str, np.ndarray] = {}

    def get(self, name: str, kind) -> np.ndarray:
        if name not in self.maps:
            path = f"{self.root}/{name}"
            self.maps[name] = np.asarray(np.memmap(path, kind, "r")) if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
        return self.maps[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Identifiers of word hashes, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)  # shards follow each other, and searches stay close to the last one
        hashes, shards = hashes[order], len(self.m.vocab_sizes)
        for k, here in by_shard(shard_of_hash(hashes, shards), shards):
            keys = self.get(f"vocab-{k}.key", np.uint64)
            if len(keys):
                pos = np.minimum(np.searchsorted(keys, hashes[here]), len(keys) - 1)
                good = keys[pos] == hashes[here]
                out[order[here[good]]] = pos[good] + self.base[k]
        return out

    def by_id(self, what: str, ids: np.ndarray) -> np.ndarray:
        """A vocabulary array's values at identifiers; 0 where unknown."""
        out = np.zeros(len(ids), np.int64)
        at = np.searchsorted(self.base, ids, "right") - 1
        for k in np.unique(at[ids >= 0]):
            here = np.flatnonzero((at == k) & (ids >= 0))
            a = self.get(f"{what}-{k}.{what}", np.int64 if what == "count" else np.uint32)
            if len(a):
                out[here] = a[ids[here] - self.base[k]]
        return out

    def _found(self, name: str, key: str, wanted: np.ndarray, values: str, kind) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ascending names a table has, and their values."""
        keys = self.get(f"{name}.{key}", np.uint64)
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros((0, 4) if values == "stats" else 0, kind)
        pos = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        good = keys[pos] == wanted
        v = self.get(f"{name}.{values}", kind)
        return good, (v.reshape(-1, 4) if values == "stats" else v)[pos[good]]

    def counts(self, k: int, names: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Counts of n-grams by ascending names and their shards; 0 where unknown."""
        out = np.zeros(len(names), np.int64)
        for j, here in by_shard(shards, self.m.shards):
            good, n = self._found(f"grams{k}-{j}", "key", names[here], "n", np.uint8)
            out[here[good]] = n
            big = here[out[here] == 255]
            if len(big):
                good, n = self._found(f"grams{k}-{j}", "bigkey", names[big], "bign", np.uint32)
                out[big[good]] = n
        return out

    def contexts(self, k: int, names: np.ndarray, shards: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """(total, n1, n2, n3) of known contexts of n-grams by ascending names, their shards, and whether they are hot."""
        out = np.tile(np.array([1, 1, 0, 0], np.int64), (len(names), 1))
        for j, here in by_shard(shards, self.m.shards):
            good, s = self._found(f"grams{k}-{j}", "ctx", names[here], "stats", np.uint32)
            out[here[good]] = s
        here = np.flatnonzero(hot)
        good, s = self._found(f"hot{k}", "ctx", names[here], "stats", np.int64)
        out[here[good]] = s
        return out


def by_shard(at: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, its rows in their order), by one pass over the rows."""
    order = np.argsort(at.astype(np.uint16) if shards < 1 << 16 else at, kind="stable")
    found, first = np.unique(at[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, first[1:]), strict=True)) if len(at) else []


def shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the upper bits, so that identifiers follow the order of hashes."""
    return np.minimum(((hashes >> np.uint64(40)).astype(np.float64) / (1 << 24) * shards).astype(np.int64), shards - 1)


def name_of(cols: list[np.ndarray]) -> np.ndarray:
    """64-bit names of rows of identifiers: exact up to two, hashed beyond."""
    out = cols[0].astype(np.uint64)
    for k, c in enumerate(cols[1:], 2):
        out = longer(out, c, k)
    return out


def longer(names: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """The names of runs of k identifiers from those of the run without the last one."""
    return (names << np.uint64(32)) | last.astype(np.uint64) if k == 2 else mix(mix(mix(names) + last.astype(np.uint64)))


def is_hot(cols: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """Whether all words of the contexts are frequent: a frequent context has no others."""
    return np.logical_and.reduce([np.isin(c, hot) for c in cols[:-1]])


def shard_of_gram(cols: list[np.ndarray], shards: int, hot: np.ndarray) -> np.ndarray:
    return shard_by(mix(name_of(cols[:-1])), cols[-1], is_hot(cols, hot), shards)


def shard_by(by: np.ndarray, last: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    by = np.where(hot, mix(by + last.astype(np.uint64)), by)
    return ((by >> np.uint64(7)) % np.uint64(shards)).astype(np.int64)


def _joined(cols: list[np.ndarray], bits: int) -> np.ndarray:
    out = cols[0].astype(np.uint64)
    for c in cols[1:]:
        out = (out << np.uint64(bits)) | c.astype(np.uint64)
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in ascending order, a place of each, and which of them stands at each place."""
    order = np.argsort(values)  # not stable, and so much faster than np.unique with places
    sorted_ = values[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return sorted_[new], order[new], back


def summed(cols: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of identifiers in ascending order, and the sums of n (of 1) over each."""
    bits = max(int(c.max(initial=1)).bit_length() for c in cols)
    wide = 64 // bits
    key, order = _joined(cols[:wide], bits), None
    for c in [None, *cols[wide:]]:
        if c is not None:  # the place of the run so far, and the next identifier
            key = (np.cumsum(new).astype(np.uint64) << np.uint64(32)) | c[order].astype(np.uint64)
        by = np.argsort(key)
        key, order = key[by], by if order is None else order[by]
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    n = np.ones(len(order), np.int64) if n is None else n[order].astype(np.int64)
    return [c[order[starts]] for c in cols], np.add.reduceat(n, starts) if len(starts) else n


class _Numbers(dict):
    """A number for each word, new ones as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Numberer:
    """Words to small numbers, and those to the model's identifiers; words that come often are kept for the next batch."""

    def __init__(self, arrays: Arrays):
        self.arrays, self.known, self.ids = arrays, _Numbers(), np.zeros(0, np.int64)

    def __call__(self, texts: list[bytes | None], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all tokens, or of the first most of each text, and the number of them of each text."""
        lists = [tokens_of(t) if most is None else first_tokens(t, most) for t in texts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, lengths.sum())
        new = np.fromiter(map(_hash, islice(self.known, len(self.ids), None)), np.uint64, len(self.known) - len(self.ids))
        self.ids = np.concatenate([self.ids, self.arrays.ids(new)])
        found = self.ids[numbers]
        if len(self.known) > KEPT_WORDS:
            often = np.bincount(numbers, minlength=len(self.ids)) > 1
            self.known, self.ids = _Numbers(zip(compress(self.known, often), range(len(self.ids)))), self.ids[often]
        return found, lengths


def _windows(ids: np.ndarray, lengths: np.ndarray, begin: int, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The k identifiers that end in each token, one begin before each text; and each token's place in its text.

    Tokens before place k - 2 have no such run: what stands in their rows means nothing.
    """
    ends = np.cumsum(lengths)
    place = np.arange(len(ids)) - np.repeat(ends - lengths, lengths)
    cols = [ids]
    for back in range(1, k):
        c = np.full(len(ids), begin, np.int64)
        c[back:] = ids[:-back]
        c[place < back] = begin
        cols.insert(0, c)
    return cols, place


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The three discounts from counts of counts; where they cannot be estimated, half of each count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k) for k, x in enumerate(d, 1))


def _pieces(batches, most: int = PIECE_BYTES):
    """The batches cut by rows into pieces of so many bytes of text, or of one text."""
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield b.slice(start, stop - start)
            start = stop


def _batches_of(b) -> list[bytes | None]:
    import pyarrow as pa

    return b.column(0).cast(pa.binary()).to_pylist()


_arrays: dict[str, Arrays] = {}


def arrays_of(model: Model) -> Arrays:
    """One per Python worker and model."""
    key = f"{model.folder}#{model.shards}#{model.types}#{model.tokens}"
    if key not in _arrays:
        _arrays.clear()
        _arrays[key] = Arrays(model)
    return _arrays[key]


def train(docs: DataFrame, shard_rows: int = SHARD_ROWS, order: int = 2) -> Model:
    """Count the texts of docs and write the model's arrays to a new folder of the shared one.

    Words first (counted in tasks, summed by a shuffle, sorted by hash: the place in that order
    is the identifier). Then the runs of order words, shuffled as compressed sorted runs to shards
    by their context; contexts of frequent words only are dealt by the last word too. Each level
    below has the number of distinct words before each run, or how often the run begins a text,
    down to the words. Null texts are empty. No documents: an empty model.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    folder = shared_path(spark, "lm")
    texts = docs.select("text")

    def words(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter = Counter()
        schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])

        def out():
            h = np.fromiter(map(_hash, seen), np.uint64, len(seen)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], schema=schema)

        for b in batches:
            for t in _batches_of(b):
                seen.update(tokens_of(t))
            if len(seen) > 1_000_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    vocab = stash(texts.mapInArrow(words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "vocab")
    row = vocab.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    n_vocab, n_tokens = row["v"], row["n"] or 0
    n_docs = docs.count()
    v_shards = max(1, math.ceil(n_vocab / shard_rows))
    upper = F.shiftrightunsigned("h", 40).cast("double") / F.lit(float(1 << 24)) * v_shards
    dealt = vocab.withColumn("shard", F.least(F.floor(upper), F.lit(v_shards - 1)).cast("int"))

    def vocabulary(table):
        import pyarrow as pa

        h = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        k = table.column("shard")[0].as_py()
        write_arrays(folder, f"vocab-{k}", key=h[order])
        write_arrays(folder, f"count-{k}", count=table.column("c").to_numpy().astype(np.int64)[order])
        return pa.table({"shard": pa.array([k], pa.int32()), "n": pa.array([len(h)])})

    sizes = dict(dealt.groupBy("shard").applyInArrow(vocabulary, "shard int, n long").collect())
    p_shards = max(1, math.ceil(n_tokens / (1.5 * shard_rows)))
    model = Model(folder, tuple(sizes.get(k, 0) for k in range(v_shards)), p_shards, n_tokens, n_docs, (), ((0.5, 1, 1.5),) * order, 0, 1.0, order)
    if not n_docs:
        return model
    often = [r["h"] for r in vocab.where(F.col("c") > n_tokens / (2 * p_shards)).select("h").collect()] if p_shards > 1 else []  # fewer than 2 p_shards
    hot = np.sort(Arrays(model).ids(np.array(often, np.int64).view(np.uint64))) if often else np.zeros(0, np.int64)
    if p_shards > 1 and n_docs > n_tokens / (2 * p_shards):
        hot = np.append(hot, n_vocab)
    begin = n_vocab

    def grams_of(k):
        """The runs of k words that the level counts by themselves: all at the top, below only those that begin a text."""

        def grams(batches):
            import pyarrow as pa

            number, held, size = Numberer(arrays_of(model)), [], 0
            schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])

            def out():
                cols, n = summed([np.concatenate(c) for c in zip(*held, strict=True)])
                rows = dealt_rows(cols, n)
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

            for b in _pieces(batches):
                ids, lengths = number(_batches_of(b), None if k == order else k - 1)
                cols, place = _windows(ids, lengths, begin, k)
                good = place >= k - 2 if k == order else place == k - 2
                if good.any():
                    held.append([c[good] for c in cols])
                    size += int(good.sum())
                if size > HELD_GRAMS:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

        return grams

    def dealt_rows(cols, n):
        at = shard_of_gram(cols, p_shards, hot)
        return [(j, squeeze(*[c[o] for c in cols], n[o])) for j, o in by_shard(at, p_shards)]

    def counter(k):
        def count_grams(table):
            import pyarrow as pa

            shard = table.column("shard")[0].as_py()
            parts = [expand(blob.as_py(), k + 1) for blob in table.column("blob")]
            *cols, n = [np.concatenate(c) for c in zip(*parts, strict=True)]
            cols, n = summed([c.astype(np.int64) for c in cols], n)
            of_counts = [int((n == c).sum()) for c in (1, 2, 3, 4)]
            rows = [("all", 0, b"", 0, *of_counts, len(n))]
            begins = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:-1]])]))  # rows of a context follow each other
            stats = np.stack([np.add.reduceat(x.astype(np.int64), begins) for x in (n, n == 1, n == 2, n >= 3)], 1)
            ctx, often = name_of(cols[:-1])[begins], is_hot([c[begins] for c in cols], hot)
            rows += [("hot", int(c), b"", *map(int, s), 0, 0) for c, s in zip(ctx[often].view(np.int64), stats[often], strict=True)]
            more = ~often & (stats[:, 0] > 1)  # a known context that is not here was seen once
            ctx, stats = ctx[more], stats[more]
            by = np.argsort(ctx)
            key = name_of(cols)
            o = np.argsort(key)
            big = o[n[o] >= 255]
            write_arrays(folder, f"grams{k}-{shard}", key=key[o], n=np.minimum(n[o], 255).astype(np.uint8), bigkey=key[big], bign=n[big].astype(np.uint32), ctx=ctx[by], stats=stats[by].astype(np.uint32))
            if k > 2:
                rows += [("next", j, blob, 0, 0, 0, 0, 0, 0) for j, blob in dealt_rows(*summed(cols[1:]))]
            else:
                u, c = np.unique(cols[1], return_counts=True)
                cuts = np.searchsorted(u, np.concatenate([[0], np.cumsum(model.vocab_sizes)]))
                rows += [("next", j, squeeze(u[cuts[j] : cuts[j + 1]], c[cuts[j] : cuts[j + 1]]), 0, 0, 0, 0, 0, 0) for j in range(v_shards) if cuts[j + 1] > cuts[j]]
            kinds = [pa.string(), pa.int64(), pa.binary()] + [pa.int64()] * 6
            return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(9)], names=["kind", "at", "blob", "total", "n1", "n2", "n3", "n4", "types"])

        return count_grams

    discounts, blobs = [], texts.mapInArrow(grams_of(order), "shard int, blob binary")
    for k in range(order, 1, -1):
        counted = blobs.groupBy("shard").applyInArrow(counter(k), "kind string, at long, blob binary, total long, n1 long, n2 long, n3 long, n4 long, types long")
        counted = stash(counted, f"grams{k}")
        sums = counted.where("kind <> 'next'").groupBy("kind", "at").agg(*[F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3", "n4", "types")]).collect()  # a row per hot context
        total = next((r for r in sums if r["kind"] == "all"), dict.fromkeys(("n1", "n2", "n3", "n4", "types"), 0))
        found = sorted((r["at"] % (1 << 64), r["total"], r["n1"], r["n2"], r["n3"]) for r in sums if r["kind"] == "hot")
        if found:
            write_arrays(folder, f"hot{k}", ctx=np.array([r[0] for r in found], np.uint64), stats=np.array([r[1:] for r in found], np.int64))
        discounts.insert(0, _discounts(total["n1"], total["n2"], total["n3"], total["n4"]))
        if k > 2:
            blobs = counted.where("kind = 'next'").select(F.col("at").cast("int").alias("shard"), "blob").union(texts.mapInArrow(grams_of(k - 1), "shard int, blob binary"))

    def before_words(table):
        import pyarrow as pa

        s = table.column("at")[0].as_py()
        base = int(np.sum(model.vocab_sizes[:s]))
        out = np.zeros(model.vocab_sizes[s], np.uint32)
        for blob in table.column("blob"):
            u, c = expand(blob.as_py(), 2)
            out[u.astype(np.int64) - base] += c
        write_arrays(folder, f"before-{s}", before=out)
        n = [int((out == c).sum()) for c in (1, 2, 3, 4)]
        return pa.table({"n1": [n[0]], "n2": [n[1]], "n3": [n[2]], "n4": [n[3]], "more": [int((out >= 3).sum())]})

    w = counted.where("kind = 'next'").select("at", "blob").groupBy("at").applyInArrow(before_words, "n1 long, n2 long, n3 long, n4 long, more long").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more")]).first()
    d1 = _discounts(w["n1"], w["n2"], w["n3"], w["n4"])
    gamma = (d1[0] * w["n1"] + d1[1] * w["n2"] + d1[2] * w["more"]) / total["types"]
    return Model(folder, model.vocab_sizes, p_shards, n_tokens, n_docs, tuple(int(h) for h in hot), (d1, *discounts), total["types"], gamma, order)


def log_probabilities(model: Model, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of the model's and of the base probability of each token, and the token counts.

    Each distinct word and run is looked up once; the contexts of a level are the distinct runs that the level below found.
    """
    a, v = arrays_of(model), model.vocab
    words, at = np.unique(ids, return_inverse=True)
    of_word = a.by_id("count", words)
    base, count = np.log10((of_word + 0.1) / (model.tokens + 0.1 * (v + 1)))[at], of_word[at]
    if not model.types:
        return np.full(len(ids), -math.log10(v + 1)), base, count
    cont = a.by_id("before", words)
    d, often = np.array([0, *model.discounts[0]]), np.array(model.hot, np.int64)
    p = (np.maximum(cont - d[np.minimum(cont, 3)], 0) / model.types + model.word_gamma / (v + 1))[at]
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # the distinct runs of the level below by ascending names, the begin being the last word, and which of them ends in a token
    known = np.append(words[words >= 0], v)
    names, hot, run = known.astype(np.uint64), np.isin(known, often), at - int((words < 0).sum())
    for k in range(2, model.order + 1):
        before = np.concatenate([[-1], run[:-1]])
        before[place < k - 2] = -1
        if k == 2:
            before[place == 0] = len(known) - 1 if model.docs else -1
        here = np.flatnonzero(before >= 0)
        context, last = before[here], np.where(ids[here] < 0, v + 1, ids[here])  # no n-gram has v + 1
        name, one, back = distinct(longer(names[context], last, k))
        of, end, by = context[one], last[one], mix(names)
        n = a.counts(k, name, shard_by(by[of], end, hot[of], model.shards))
        s = a.contexts(k, names, shard_by(by, by, np.zeros(len(by), bool), model.shards), hot)
        d = np.array([0, *model.discounts[k - 1]])
        p[here] = (np.maximum(n - d[np.minimum(n, 3)], 0) / s[of, 0])[back] + (s[:, 1:] @ d[1:] / s[:, 0])[context] * p[here]
        good = n > 0
        run = np.full(len(ids), -1, np.int64)
        run[here] = np.where(good, np.cumsum(good) - 1, -1)[back]
        names, hot = name[good], hot[of][good]
        hot[hot] = np.isin(end[good][hot], often)
    return np.log10(p), base, count


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of every text; null texts are empty, rows stay as they are."""
    kind = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"

    def run(batches):
        import pyarrow as pa

        number = Numberer(arrays_of(model))
        for b in _pieces(batches):
            texts = _batches_of(b)
            if not texts:
                continue
            ids, lengths = number(texts)
            lp, base, count = log_probabilities(model, ids, lengths)
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            s = np.add.reduceat(lp, at)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(lengths), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(s), pa.array(10 ** (-s / lengths))], names=[c.split()[0] for c in kind.split(", ")])

    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, kind)
