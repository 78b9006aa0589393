"""Benchmark decontamination: winnowed fingerprints joined, then extended along their diagonals to maximal shared spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, content_key, plain_words, small, stash

#: Words in a window, words in a k-gram. Any shared span of WINDOW words holds WINDOW - GRAM + 1
#: consecutive k-grams, and both sides keep the least hash of every such run.
WINDOW, GRAM = 10, 5
#: Benchmark words up to which the item texts are broadcast (some 16 MB).
ITEM_WORDS = 1_000_000


def _gram(hashes: Column, at: Column, k: int) -> Column:
    """The hash of the k words from a position on."""
    return F.xxhash64(F.lit(k), *[F.get(hashes, at + j) for j in range(k)])


def _least(hashes: Column, at: Column, window: int, gram: int) -> Column:
    """The least gram hash of the window that begins at a position."""
    return F.least(*[_gram(hashes, at + j, gram) for j in range(window - gram + 1)])


def _starts(count: Column, k: int) -> Column:
    return F.explode(F.when(count >= k, F.sequence(F.lit(0), count - k)))


def _holding(hashes: Column, at: Column, mark: Column, window: int, gram: int) -> Column:
    """Positions in the window whose gram hash is its mark."""
    return F.explode(F.array_compact(F.array(*[F.when(_gram(hashes, at + j, gram) == mark, at + j) for j in range(window - gram + 1)])))


def _first_holding(hashes: Column, at: Column, mark: Column, window: int, gram: int) -> Column:
    """The first position in the window whose gram hash is its mark."""
    return F.coalesce(*[F.when(_gram(hashes, at + j, gram) == mark, at + j) for j in range(window - gram + 1)])


def _words(df: DataFrame) -> DataFrame:
    """Add the number of words and their hashes; full lower-casing can only add candidates, which are then compared."""
    return df.withColumn("n", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(F.lower(w))))


def shared_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Maximal word spans that a document shares with an item: (doc_id, text_key, item_id, begin, end).

    docs has doc_id and text, items item_id and text; other columns are ignored. A span covers
    at least window words, or the whole of an item with fewer words. begin and end count words
    from 0, end exclusive. Null or wordless texts share nothing; items without item_id are
    ignored; repeated rows give the spans of one. No items or no documents: no rows.
    """
    item = items.where("item_id is not null").select("item_id", F.col("text").alias("_t")).withColumn("iw", F.transform(plain_words(F.col("_t")), ascii_lower)).where(F.size("iw") > 0)
    item = stash(item.select("item_id", content_key(F.col("_t")).alias("item_key"), "iw").dropDuplicates(["item_id", "item_key"]), "items")
    shorts = sorted(r[0] for r in item.select(F.size("iw").alias("n")).where(F.col("n") < window).distinct().collect())
    n_words = item.agg(F.sum(F.size("iw"))).first()[0] or 0

    fp = _words(item.withColumnRenamed("iw", "words"))
    i, h = F.col("i"), F.col("h")
    wide = fp.where(F.col("n") >= window).select("item_id", "item_key", "n", "h", _starts(F.col("n"), window).alias("i")).withColumn("mark", _least(h, i, window, gram))
    table = wide.select("item_id", "item_key", "n", "mark", _holding(h, i, F.col("mark"), window, gram).alias("q")).distinct()
    for k in shorts:
        table = table.unionByName(fp.where(F.col("n") == k).select("item_id", "item_key", "n", _gram(h, F.lit(0), k).alias("mark"), F.lit(0).alias("q")))
    table = stash(table, "marks")
    n_marks = table.count()

    d = docs.select("doc_id", "text").where("text is not null").select("doc_id", content_key(F.col("text")).alias("text_key"), plain_words(F.col("text")).alias("words"))
    d = _words(d).withColumnRenamed("n", "dn")
    # one pass over the documents for full windows and all lengths of shorter items
    widths = F.explode(F.filter(F.array(*[F.lit(k) for k in (window, *shorts)]), lambda k: k <= F.col("dn")))
    rows = d.select("doc_id", "text_key", "words", "dn", "h", widths.alias("k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("dn") - F.col("k"))))
    mark, place = F.when(F.col("k") == window, _least(h, i, window, gram)), F.when(F.col("k") == window, _first_holding(h, i, F.col("mark"), window, gram)).otherwise(i)
    for k in shorts:
        mark = mark.when(F.col("k") == k, _gram(h, i, k))
    rows = rows.withColumn("mark", mark)
    marks = table.withColumn("k", F.least(F.col("n"), F.lit(window)))
    diagonal = ["doc_id", "text_key", "item_id", "item_key", "shift"]
    if n_marks <= BROADCAST_ROWS:
        hits = rows.join(F.broadcast(marks), ["k", "mark"]).select("doc_id", "text_key", "item_id", "item_key", "n", (place - F.col("q")).alias("shift"), F.col("words").alias("dw")).dropDuplicates(diagonal)
    else:  # only fingerprints are shuffled, each once a document; the texts come back for documents with a match
        prints = rows.select("doc_id", "text_key", "k", "mark", place.alias("p")).distinct()
        shifts = prints.join(marks, ["k", "mark"]).select("doc_id", "text_key", "item_id", "item_key", "n", (F.col("p") - F.col("q")).alias("shift")).distinct()
        shifts = shifts.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_k")
        texts = d.select("doc_id", "text_key", F.col("words").alias("dw")).dropDuplicates(["doc_id", "text_key"])
        hits = texts.join(shifts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))).drop("_d", "_k")
    # a diagonal is compared once, over all that document and item overlap on it
    begin, at = F.greatest(F.col("shift"), F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    size = F.least(F.size("dw") - begin, F.col("n") - at)
    hits = hits.select("doc_id", "text_key", "item_id", "item_key", "n", begin.alias("begin"), at.alias("at"), size.alias("size"), F.transform(F.slice("dw", begin + 1, size), ascii_lower).alias("seg"))
    full = hits.join(small(item, n_words, ITEM_WORDS), ["item_id", "item_key"])
    same = full.select("doc_id", "text_key", "item_id", "begin", "size", F.least(F.col("n"), F.lit(window)).alias("least"), F.zip_with("seg", F.slice("iw", F.col("at") + 1, F.col("size")), lambda x, y: x == y).alias("same"))
    stops = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda j: ~F.get("same", j)), F.array(F.col("size")))
    runs = same.withColumn("stops", stops).select("doc_id", "text_key", "item_id", "begin", "least", F.explode(F.zip_with("stops", F.slice("stops", 2, F.size("stops")), lambda x, y: F.struct((x + 1).alias("a"), y.alias("b")))).alias("run"))
    return runs.where(F.col("run.b") - F.col("run.a") >= F.col("least")).select("doc_id", "text_key", "item_id", (F.col("begin") + F.col("run.a")).alias("begin"), (F.col("begin") + F.col("run.b")).alias("end")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    n_hit counts the words inside any shared span, items lists the item_ids that occur, as
    sorted strings. Repeated rows stay; each has the result of its text. Empty table: no rows.
    """
    spans = shared_spans(docs, items, window, gram)
    per = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct((a["hit"] + F.greatest(s["end"] - F.greatest(s["begin"], a["upto"]), F.lit(0))).alias("hit"), F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["hit"])
    per = per.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), covered.cast("long").alias("_hit"), "items", "spans")
    base = docs.select("doc_id", content_key(F.col("text")).alias("text_key"), F.size(plain_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    n_hit = F.coalesce("_hit", F.lit(0).cast("long"))
    items_out = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(items_out).cast("long").alias("n_items"), items_out.alias("items"), "spans", (n_hit > 0).alias("contaminated"))
