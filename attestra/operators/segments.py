"""Text preparation and extraction: sentences, chunks, windows, tokens, mentions in windows, scored pairs (B, C)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.components import ensure_checkpoints, stored

# Words whose full stop ends no sentence.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "sen", "rep", "gov", "pres", "st", "jr", "sr", "vs", "etc", "inc", "co", "ltd"]
SPACE = r" \t\n\r\x0B\f ".encode().decode("unicode_escape")
SPANS = "array<struct<s:int,e:int>>"
TOKEN = re.compile(r"[^ \t\n\r\f]+")


def _cut_at(pattern: str, text: Column) -> Column:
    """The pieces of a text cut at zero-width matches, as spans without their leading white space."""
    pieces = F.split(text, pattern)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p)
        span = F.struct((end - F.length(F.ltrim(p, F.lit(SPACE)))).alias("s"), end.alias("e"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pieces, zero, add, lambda acc: acc["out"])


def sentences(docs: DataFrame) -> DataFrame:
    """(video_id, start, end) of the sentences of (video_id, text).

    A sentence ends with . ! ? before white space or the end, or with a line break; the full stop
    of an abbreviation ends none. Blank ones are left out; leading white space belongs to none. A piece
    is looked at by itself, its text's rest is not beside it. Documents are dealt to tasks first, as a file may come as one.
    """
    after = f"(?=[{SPACE}]|$(?![\\s\\S]))"
    stop = rf"(?<!(?<![A-Za-z])(?i:{'|'.join(ABBREVIATIONS)}))\."
    cut = rf"(?<=\n)|(?<=[!?]){after}|(?<={stop}){after}"
    rows = docs.repartition("video_id").select("video_id", F.explode(_cut_at(cut, F.col("text"))).alias("p"))
    return rows.select("video_id", F.col("p.s").alias("start"), F.col("p.e").alias("end")).where(F.col("start") < F.col("end"))


#: Spans of a document from which on its cuts are found by doubling, not in one array.
LONG = 2_000


def greedy_groups(spans: DataFrame, limit: int) -> DataFrame:
    """spans (video_id, s, e, ...) with group: consecutive ones joined while the whole is within limit, for documents of any length.

    Spans don't overlap. Each span knows where the group that began with it would be cut: behind the last end
    within limit, counted over one sorted run of ends and reaches. The cuts that count are those reached from the
    first span; they are followed by doubling, so that the rounds are the logarithm of the groups.
    """
    ensure_checkpoints(spans.sparkSession)
    of = Window.partitionBy("video_id")
    n = spans.withColumn("_i", F.row_number().over(of.orderBy("s", "e"))).withColumn("_last", F.count(F.lit(1)).over(of)).checkpoint()
    marks = n.select("video_id", F.col("e").alias("pos"), F.lit(0).alias("ask"), F.lit(None).cast("int").alias("_i"), "_last").union(n.select("video_id", F.col("s") + limit, F.lit(1), "_i", "_last"))
    within = F.sum(1 - F.col("ask")).over(of.orderBy("pos", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    jump = marks.withColumn("within", within).where("ask = 1").select("video_id", "_i", (F.greatest(F.col("_i"), F.col("within")) + 1).cast("int").alias("to"), "_last").where("to <= _last").drop("_last").checkpoint()
    starts = n.where("_i = 1").select("video_id", "_i").checkpoint()
    while True:
        found = starts.join(jump, ["video_id", "_i"]).select("video_id", F.col("to").alias("_i")).checkpoint()
        if not found.limit(1).count():
            break
        starts = starts.union(found).checkpoint()
        jump = jump.join(jump.select("video_id", F.col("_i").alias("to"), F.col("to").alias("_next")), ["video_id", "to"]).select("video_id", "_i", F.col("_next").alias("to")).checkpoint()
    flagged = n.join(starts.withColumn("_start", F.lit(1)), ["video_id", "_i"], "left")
    return flagged.withColumn("group", (F.sum(F.coalesce("_start", F.lit(0))).over(of.orderBy("_i")) - 1).cast("int")).drop("_start", "_last").withColumnRenamed("_i", "place")


def _by_length(rows: DataFrame, long: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of documents of at most `long` rows, those of longer ones or None)."""
    ensure_checkpoints(rows.sparkSession)
    sized = stored(rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("video_id"))))
    longer = sized.where(F.col("_n") > long).drop("_n")
    return sized.where(F.col("_n") <= long).drop("_n"), longer if longer.limit(1).count() else None


def merged_windows(spans: DataFrame, limit: int = 500, long: int = LONG) -> DataFrame:
    """(video_id, window, start, end): consecutive spans joined while the whole is within limit.

    Documents of up to `long` spans are cut in an array, longer ones by greedy_groups.
    """
    from attestra.functions.text import merge_windows

    short, longer = _by_length(spans.select("video_id", F.col("start").alias("s"), F.col("end").alias("e")), long)
    per = short.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    out = per.select("video_id", F.posexplode(merge_windows(F.col("spans"), limit)).alias("window", "w")).select("video_id", "window", F.col("w.s").alias("start"), F.col("w.e").alias("end"))
    if longer is None:
        return out
    far = greedy_groups(longer, limit).groupBy("video_id", F.col("group").alias("window")).agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return out.union(far)


def line_chunks(docs: DataFrame, limit: int = 800, long: int = LONG) -> DataFrame:
    """(video_id, chunk, start, text): lines joined by line breaks while within limit; a longer line stands alone, blank ones are left out.

    A text without any other line is one chunk as it is. Texts of more than `long` lines are cut by greedy_groups.
    """
    many = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)) > long
    return _short_line_chunks(docs.where(~many), limit).union(_long_line_chunks(docs.where(many), limit))


def _long_line_chunks(docs: DataFrame, limit: int) -> DataFrame:
    of = Window.partitionBy("video_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = docs.select("video_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(of), F.lit(0)))
    said = lines.where(F.regexp_replace("text", f"[{SPACE}]+", "") != "")
    # as if blank lines were not there, so that a chunk's length is that of its lines and the breaks between them
    said = said.withColumn("s", F.coalesce(F.sum(F.length("text") + 1).over(of), F.lit(0))).withColumn("e", F.col("s") + F.length("text"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    out = greedy_groups(said, limit).groupBy("video_id", F.col("group").alias("chunk")).agg(F.min("start").cast("int").alias("start"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    blank = docs.join(said.select("video_id").distinct(), "video_id", "left_anti").select("video_id", F.lit(0).alias("chunk"), F.lit(0).alias("start"), "text")
    return out.union(blank)


def _short_line_chunks(docs: DataFrame, limit: int) -> DataFrame:
    lines = F.split("text", "\n")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,t:string,open:boolean>>").alias("out"))

    def add(acc: Column, line: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        fits = F.coalesce(last["open"] & (F.length(last["t"]) + 1 + F.length(line) <= limit), F.lit(False)) & (F.length(line) <= limit)
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), F.concat(last["t"], F.lit("\n"), line).alias("t"), F.lit(True).alias("open"))))
        fresh = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), line.alias("t"), (F.length(line) <= limit).alias("open"))))
        out = F.when(F.regexp_replace(line, f"[{SPACE}]+", "") == "", acc["out"]).when(fits, grown).otherwise(fresh)
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), out.alias("out"))

    chunks = F.aggregate(lines, zero, add, lambda acc: acc["out"])
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("text").alias("t"), F.lit(True).alias("open")))
    rows = docs.withColumn("_c", chunks).withColumn("_c", F.when(F.size("_c") == 0, whole).otherwise(F.col("_c")))
    return rows.select("video_id", F.posexplode("_c").alias("chunk", "c")).select("video_id", "chunk", F.col("c.s").alias("start"), F.col("c.t").alias("text"))


#: Tokens that a Python task holds before it hands them on.
TOKEN_ROWS = 100_000


def tokens(docs: DataFrame) -> DataFrame:
    """(video_id, token_idx, start, end, token) of runs other than white space. Documents are dealt to tasks, each text is cut in one pass."""
    video = docs.schema["video_id"].dataType.simpleString()

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        names, rows = ["video_id", "token_idx", "start", "end", "token"], []
        for f in frames:
            for key, text in zip(f["video_id"], f["text"], strict=True):
                for i, m in enumerate(TOKEN.finditer(text or "")):
                    rows.append((key, i, m.start(), m.end(), m[0]))
                    if len(rows) >= TOKEN_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    return docs.select("video_id", "text").repartition("video_id").mapInPandas(run, f"video_id {video}, token_idx int, start int, end int, token string")


def token_ranges(toks: DataFrame, spans: DataFrame, width: int = 512) -> DataFrame:
    """(video_id, start, end, first_token, last_token): the inclusive range of tokens that a span overlaps.

    Both sides are dealt by blocks of width characters, so that no document's tokens all meet all its spans.
    """
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    t = toks.select("video_id", blocks(F.col("start"), F.col("end")).alias("block"), F.col("start").alias("ts"), F.col("end").alias("te"), "token_idx")
    s = spans.select("video_id", "start", "end").distinct().withColumn("block", blocks(F.col("start"), F.col("end")))
    hit = s.join(t, ["video_id", "block"]).where((F.col("start") < F.col("te")) & (F.col("end") > F.col("ts")))
    return hit.groupBy("video_id", "start", "end").agg(F.min("token_idx").alias("first_token"), F.max("token_idx").alias("last_token"))


def quotes(spans: DataFrame, docs: DataFrame, window: int = 160) -> DataFrame:
    """Spans with quote: the text from half a window before to half a window after, white space collapsed."""
    j = spans.join(docs.select("video_id", "text"), "video_id")
    lo = F.greatest(F.col("start") - window // 2, F.lit(0))
    raw = F.substring(F.col("text"), lo + 1, F.col("end") + window // 2 - lo)
    return j.withColumn("quote", F.regexp_replace(F.regexp_replace(raw, f"[{SPACE}]+", " "), "^ +| +$", "")).drop("text")


def embedding_text(text: Column, cap: int = 4000) -> Column:
    """Without control characters other than tab and line break, trimmed, a blank text one space, at most cap characters."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", ""), r"^\s+|\s+$", "")
    return F.substring(F.when(clean == "", " ").otherwise(clean), 1, cap)


def scored_chunks(chunks: DataFrame, scorer: Callable | None) -> DataFrame:
    """(video_id, start, end, label, score, surface) of what scorer finds in (video_id, start, text), offsets in the document.

    scorer(text) yields (start, end, label, score); a chunk on which it fails is skipped. No scorer, no rows.
    """
    kind = "video_id string, start int, end int, label string, score double, surface string"
    if scorer is None:
        return chunks.sparkSession.createDataFrame([], kind)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for video, at, text in zip(f["video_id"], f["start"], f["text"], strict=True):
                try:
                    rows += [(video, int(at) + s, int(at) + e, label, float(score), text[s:e]) for s, e, label, score in scorer(text)]
                except Exception:  # noqa: BLE001, S112 - a model may fail on one chunk in any way
                    continue
            yield pd.DataFrame(rows, columns=["video_id", "start", "end", "label", "score", "surface"])

    return chunks.select("video_id", "start", "text").mapInPandas(run, kind)


class TermScorer:
    """The default scorer of C1: whole words of a list of terms, each with its label."""

    def __init__(self, terms: dict[str, tuple[str, float]]):
        self.terms = terms

    def __call__(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        for m in re.finditer(r"\w+", text):
            if m[0] in self.terms:
                label, score = self.terms[m[0]]
                yield m.start(), m.end(), label, score


def best_mentions(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of equal (start, end, label) the best score, from the threshold on."""
    return scored.where(F.col("score") >= threshold).groupBy("video_id", "start", "end", "label").agg(F.max("score").alias("score"), F.max_by("surface", "score").alias("surface"))


def in_windows(mentions: DataFrame, windows: DataFrame, width: int = 500, least: int = 2) -> DataFrame:
    """(video_id, window, win_start, win_end, mention_id, start, end, ...) of mentions that lie in a window with at least two.

    A window is dealt to the blocks that it touches, a mention to the block of its start.
    """
    w = windows.select("video_id", "window", F.col("start").alias("win_start"), F.col("end").alias("win_end"))
    w = w.withColumn("block", F.explode(F.sequence(F.floor(F.col("win_start") / width), F.floor(F.col("win_end") / width))))
    m = mentions.withColumn("block", F.floor(F.col("start") / width))
    held = m.join(w, ["video_id", "block"]).where("start >= win_start and `end` <= win_end").drop("block")
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id", "window"))
    return held.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def mention_pairs(held: DataFrame, cap: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of each window the pairs (a, b) of mentions whose middles are nearest, at most cap; ties in text order.

    Mentions are sorted by their middles and each looks a few places ahead: a pair n places apart has
    n (n + 1) / 2 - 1 pairs inside it that are no farther apart, so the nearest lie close. Pairs farther
    on matter only where they equal the last distance; those are looked up by the middle. Of
    mentions with one middle only the first cap + 1 can be in a result. A task takes windows as they lie sorted in its
    partition, so that no pair is shuffled. Columns of mentions to carry come as a_<column> and b_<column>.
    """
    where = ["video_id", "window"]
    along = Window.partitionBy(*where).orderBy("_mid", "start", "mention_id")
    m = held.select(*where, "mention_id", "start", (F.col("start") + F.col("end")).cast("long").alias("_mid"), *carry)
    m = m.withColumn("_place", F.row_number().over(along))
    kind = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    sides = [(f"{s}_{c}", c) for c in carry for s in ("a", "b")]
    types = ", ".join(f"`{n}` {kind[c]}" for n, c in [*((c, c) for c in where), ("rank", "_place"), ("a", "mention_id"), ("b", "mention_id")])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def told(t: pa.Table) -> Iterator:
            name = np.empty(len(t), np.int64)
            name[pc.sort_indices(t["mention_id"]).to_numpy()] = np.arange(len(t))
            g, rank, a, b, distance = nearest_pairs(*(t[c].to_numpy() for c in ("_place", "_mid", "start")), name, cap)
            out = {**{c: t[c].take(pa.array(g)) for c in where}, "rank": pa.array(rank, pa.int32()), "a": t["mention_id"].take(pa.array(a)), "b": t["mention_id"].take(pa.array(b)), "distance": pa.array(distance)}
            out |= {name: t[c].take(pa.array(a if name.startswith("a_") else b)) for name, c in sides}
            yield from pa.table(out).to_batches()

        open_: list = []  # what has come of windows that may go on in the next batch
        for batch in batches:
            starts = (batch["_place"].to_numpy() == 1).nonzero()[0]
            if len(starts):
                whole = pa.Table.from_batches([*open_, batch.slice(0, starts[-1])])
                open_ = []
                yield from told(whole)
                batch = batch.slice(starts[-1])
            open_.append(batch)
        if open_:
            yield from told(pa.Table.from_batches(open_))

    return m.mapInArrow(run, f"{types}, distance double" + "".join(f", `{n}` {kind[c]}" for n, c in sides))


def nearest_pairs(place: np.ndarray, mid: np.ndarray, start: np.ndarray, name: np.ndarray, cap: int) -> tuple[np.ndarray, ...]:
    """(a row of the window, rank, a, b, distance) of mention_pairs: rows lie by window, double middle, start and id; place counts from 1 in each window, name is the id's rank."""
    reach = max(n for n in range(1, cap + 2) if n * (n + 1) // 2 - 1 < cap)
    group = np.cumsum(place == 1)
    run = np.append(True, (group[1:] != group[:-1]) | (mid[1:] != mid[:-1]))[: len(mid)]
    at = np.arange(len(mid))
    kept = at[at - np.maximum.accumulate(np.where(run, at, 0)) <= cap]
    group, mid, start, name, n = group[kept], mid[kept], start[kept], name[kept], len(kept)
    ahead = [np.flatnonzero(group[k:] == group[: max(n - k, 0)]) for k in range(1, reach + 1)]
    one, two = np.concatenate(ahead), np.concatenate([i + k for k, i in enumerate(ahead, 1)])
    # the cap-th distance of a window, where it has as many
    order = np.lexsort((mid[two] - mid[one], group[one]))
    of = group[one][order]
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    nth = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    last = np.full(int(group.max(initial=0)) + 1, -1)
    last[of[nth == cap - 1]] = (mid[two] - mid[one])[order][nth == cap - 1]
    # farther pairs of just that distance
    i = np.flatnonzero(last[group] >= 0)
    wide = int(mid.max(initial=0)) + int(last.max(initial=0)) + 1
    low = min(int(mid.min(initial=0)), 0)
    key = group * (wide - low) + (mid - low)
    begin = np.maximum(np.searchsorted(key, key[i] + last[group[i]]), i + reach + 1)
    end = np.searchsorted(key, key[i] + last[group[i]], "right")
    many = np.maximum(end - begin, 0)
    far = np.arange(int(many.sum())) + np.repeat(begin - np.cumsum(many) + many, many)
    x, y = np.append(one, np.repeat(i, many)), np.append(two, far)
    distance = mid[y] - mid[x]
    text = np.empty(n, np.int64)
    text[np.lexsort((name, start, group))] = np.arange(n)
    swap = text[x] > text[y]
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((text[b], text[a], distance, group[a]))
    a, b, distance = a[order], b[order], distance[order]
    of = group[a]
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0)) + 1
    good = rank <= cap
    return kept[a[good]], rank[good].astype(np.int32), kept[a[good]], kept[b[good]], distance[good] / 2.0


def participants(pairs: DataFrame) -> DataFrame:
    """(video_id, window, position, mention_id): each window's mentions in the order of their first use in its pairs."""
    used = pairs.select("video_id", "window", "a", "b", "rank").repartition("video_id", "window").select("video_id", "window", F.posexplode(F.array("a", "b")).alias("side", "mention_id"), "rank")
    first = used.groupBy("video_id", "window", "mention_id").agg(F.min(F.struct("rank", "side")).alias("first"))
    return first.select("video_id", "window", (F.row_number().over(Window.partitionBy("video_id", "window").orderBy("first")) - 1).alias("position"), "mention_id")


def scored_pairs(inputs: DataFrame, scorer: Callable) -> DataFrame:
    """Inputs with predicate and score, the best that scorer says of each pair; pairs without an answer are left out.

    scorer(subject, object, text) yields (label, score); labels are written with spaces and kept with underscores.
    """
    kind = f"{inputs._jdf.schema().toDDL()}, predicate string, score double"

    def run(frames: Iterator) -> Iterator:
        for f in frames:
            best = [max(scorer(s, o, t), key=lambda x: x[1], default=None) for s, o, t in zip(f["subject"], f["object"], f["text"], strict=True)]
            f = f.assign(predicate=[b and b[0].replace(" ", "_") for b in best], score=[b and float(b[1]) for b in best])
            yield f[f["predicate"].notna()]

    return inputs.mapInPandas(run, kind)


def kept_relations(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """C11: scored pairs (subject_id, object_id, subject, object, predicate, score) from their predicate's threshold on (1 where it has none), without loops."""
    least = F.lit(1.0)
    for name, t in thresholds.items():
        least = F.when(F.col("predicate") == name, t).otherwise(least)
    same = (F.col("subject_id") == F.col("object_id")) | (F.lower(F.trim("subject")) == F.lower(F.trim("object")))
    return scored.where(~same & (F.col("score") >= least))


def numbered_edges(edges: DataFrame) -> DataFrame:
    """r_0001, r_0002, ... within each document by window, subject, object; evidence is the window's span."""
    w = Window.partitionBy("video_id").orderBy("window", "subject_id", "object_id", "predicate")
    return edges.withColumn("edge_id", F.format_string("r_%04d", F.row_number().over(w)))


def aligned(mentions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C14: (mentions, documents): documents (video_id, text, rewritten) with applied, whether rewriting kept the length; the mentions of others are dropped."""
    flagged = docs.withColumn("applied", F.length("text") == F.length("rewritten"))
    return mentions.join(flagged.where("applied").select("video_id"), "video_id", "left_semi"), flagged


def cue_offsets(cues: DataFrame) -> DataFrame:
    """B1: cues (video_id, cue_idx, text) with char_start, where each begins in its document's text joined by line breaks, and n_chars."""
    before = Window.partitionBy("video_id").orderBy("cue_idx").rowsBetween(Window.unboundedPreceding, -1)
    return cues.withColumns({"char_start": F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"), "n_chars": F.length("text").cast("long")})


def cue_at(cues: DataFrame, offsets: DataFrame) -> DataFrame:
    """B2: (video_id, pos, cue_idx, time) of offsets (video_id, pos): the last cue that begins at or before each; without one: no row.

    Cues and offsets are laid in one order and the last cue is carried on, so no cue meets all offsets.
    """
    at = cue_offsets(cues).select("video_id", F.col("char_start").alias("pos"), F.lit(0).alias("kind"), "cue_idx", "start")
    both = at.unionByName(offsets.select("video_id", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("cue_idx"), F.lit(None).cast("double").alias("start")))
    last = F.last(F.when(F.col("kind") == 0, F.struct("cue_idx", "start")), ignorenulls=True).over(Window.partitionBy("video_id").orderBy("pos", "kind", "cue_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("at", last).where("kind = 1 and at is not null").select("video_id", "pos", F.col("at.cue_idx").alias("cue_idx"), F.col("at.start").alias("time"))


def line_search(cues: DataFrame, text: str) -> DataFrame:
    """Cues whose text holds the given one, whatever the case; an empty text finds none."""
    return cues.where(F.lower("text").contains(text.lower()) if text.strip() else F.lit(False))
