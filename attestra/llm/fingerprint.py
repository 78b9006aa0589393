"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import content_key, range_index, split_bounds

#: Hashes kept in a sketch, words in a shingle.
KEEP, SHINGLE = 128, 5


def sketch(text: Column, keep: int = KEEP, shingle: int = SHINGLE) -> Column:
    """The keep least hashes of the text's shingles, ascending; fewer words than a shingle are one shingle.

    Null and blank texts have the empty sketch.
    """
    hashes = F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""), lambda w: F.xxhash64(w))

    def joined(parts: Column, more: Column, by: int) -> Column:
        return F.zip_with(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - by, F.lit(0))), F.slice(more, F.lit(by + 1), F.size(more)), lambda a, b: F.xxhash64(a, b))

    def widened(grams: Column, by: int) -> Column:
        return F.get(F.transform(F.array(grams), lambda g: joined(g, g, by)), F.lit(0))

    def shingles(h: Column) -> Column:
        grams, width = h, 1
        while width < shingle:  # runs of twice the width, then what is left
            by = min(width, shingle - width)
            grams, width = widened(grams, by), width + by
        least = F.slice(F.sort_array(F.array_distinct(grams)), 1, keep)
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < shingle, F.array(F.xxhash64(h))).otherwise(least)

    return F.get(F.transform(F.array(hashes), shingles), F.lit(0))


def merge(a: Column, b: Column, keep: int = KEEP) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, keep)


def merge_sketches(df: DataFrame, key: str, column: str, keep: int = KEEP) -> DataFrame:
    """One sketch per key, of all its rows' sketches; partial aggregates hold distinct hashes only."""
    ranked = df.select(key, F.explode(column).alias("h")).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("_r") <= keep)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))


def resemblance(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Estimated Jaccard likeness, exact while the union has at most keep shingles; two empty sketches: 1."""
    both = merge(a, b, keep)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct_shingles(a: Column, keep: int = KEEP) -> Column:
    """Estimated number of distinct shingles, exact below keep."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < keep, F.size(a).cast("double")).otherwise((keep - 1) / top)


def containment(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a: 1."""
    na, nb, j = distinct_shingles(a, keep), distinct_shingles(b, keep), resemblance(a, b, keep)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], rows_each: int = 64, most: int = 1024) -> DataFrame:
    """Add next_<column> of the document that follows in descending doc_id (after the last: the first).

    Rows go once to ranges of doc_id, each sorted by itself; the first row of every range also
    goes, as a guest, to the end of the range before, so no join is needed. Rows with equal doc_id follow each other by text;
    rows without doc_id come last; repeated rows count as neighbours of each other.
    """
    n = docs.count()
    bounds = split_bounds(docs, "doc_id", min(most, max(1, n // rows_each)))
    index = range_index(F.col("doc_id"), bounds)
    tops = docs.groupBy(index.alias("range")).agg(F.max("doc_id").alias("top"), F.min_by(content_key(F.col("text")), "text").alias("key")).orderBy("range").collect()  # at most `most` + 1 rows
    full = [r["range"] for r in tops]
    after = dict(zip(full, [*full[1:], *full[:1]], strict=True))  # the range whose last row the first row of this one follows
    is_top = F.col("doc_id").isin([r["top"] for r in tops if r["top"] is not None]) | (F.col("doc_id").isNull() & F.lit(False))
    for r in tops:
        if r["top"] is None:
            is_top = F.coalesce(is_top, F.lit(False)) | (F.col("doc_id").isNull() & (content_key(F.col("text")) == r["key"]))
    also = F.element_at(F.array(*[F.lit(after.get(k, 0)) for k in range(-1, len(bounds) + 1)]), index + 2)
    place = F.explode(F.when(F.coalesce(is_top, F.lit(False)), F.array(F.struct(index.alias("range"), F.lit(False).alias("guest")), F.struct(also.alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(index.alias("range"), F.lit(False).alias("guest")))))
    ranged = docs.select(*docs.columns, place.alias("_at"))
    order = Window.partitionBy("_at.range").orderBy("_at.guest", F.col("doc_id").desc_nulls_last(), F.col("text"))
    out = ranged.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where(~F.col("_at.guest"))
    return out.select(*docs.columns, *[F.col("_next")[c].alias(f"next_{c}") for c in columns])


def document_fingerprints(docs: DataFrame, keep: int = KEEP) -> DataFrame:
    """doc_id, n_chars, sketch for every row, in the row's own terms; null texts count as empty, other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"), sketch(text, keep).alias("sketch"))


__all__ = ["as_text", "containment", "content_key", "distinct_shingles", "document_fingerprints", "merge", "merge_sketches", "resemblance", "sketch", "with_next"]
