"""Column helpers: tokens, keys, likeness, links, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOP_WORDS = """the and but for with that this from into than then has have had not was were are been being its their
they them also such which what when where while who whom whose""".split()
# Surfaces that name nobody.
PRONOUNS = """i me my mine myself you your yours yourself yourselves he him his himself she her hers herself we us our
ours ourselves they them their theirs themselves it its itself this that these those who whom whose which what
i'm you're he's she's we're they're it's i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll
she'll we'll they'll one ones someone anyone everyone nobody thing things something anything everything""".split()
# Phrases of hesitation, evasion and exaggeration, with the weight of each kind.
HEDGES = ["maybe", "i think", "i guess", "sort of", "kind of", "i suppose", "probably", "possibly"]
EVASIONS = ["no comment", "i don't recall", "can't recall", "not that i know of", "i'd have to check", "i don't remember"]
ABSOLUTES = ["never", "always", "100%", "every single", "nobody", "everyone"]
WEIGHTS = {"hedge": -0.02, "evasion": -0.08, "absolute": -0.03, "self": -0.15, "graph": -0.2}


#: What is in no word: all but ASCII letters, digits and _.
NOT_WORD = "[^a-z0-9_]+"


def entity_key(label: Column, canonical: Column) -> Column:
    """label:canonical, lower case, white space collapsed."""
    return F.concat_ws(":", label, F.regexp_replace(F.trim(F.lower(canonical)), r"\s+", " "))


def token_set(text: Column, longer_than: int = 2, stop: list[str] | None = None, apart: str = "[^a-z0-9]+") -> Column:
    """Distinct lower-case tokens above a length, without stop words; apart is the pattern between them (NOT_WORD keeps _ in them)."""
    found = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), apart), lambda w: F.length(w) > longer_than))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop])) if stop else found


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; two empty sets: 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero vector gives 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def clean_surface(text: Column) -> Column:
    """Lower case, without characters other than ASCII letters, digits and _ at the ends, spaces collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"^[^a-z0-9_]+|[^a-z0-9_]+$", ""), r"[ \t\n\r\u00A0]+", " ")


def deep_link(video_id: Column, seconds: Column, base: str = "https://watch.example/") -> Column:
    return F.concat(F.lit(base), F.url_encode(video_id), F.lit("?t="), F.floor(seconds).cast("string"))


def clock(seconds: Column) -> Column:
    """mm:ss, with more digits for minutes from 100 on."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def subkind(rationale: Column) -> Column:
    """The bracketed kind that begins a rationale, lower case; null if none."""
    found = F.lower(F.regexp_extract(F.coalesce(rationale, F.lit("")), r"(?i)^\s*\[(logical|debunks|alternative|undercuts)\]", 1))
    return F.when(found != "", found)


def without_subkind(rationale: Column) -> Column:
    return F.regexp_replace(rationale, r"(?i)^\s*\[(logical|debunks|alternative|undercuts)\]\s*", "")


def truth_label(truth: Column) -> Column:
    """Seven bands of a truth value; null stays null."""
    out = F.when(truth >= 0.85, "very likely true").when(truth >= 0.65, "likely true").when(truth > 0.55, "leans true")
    out = out.when(truth >= 0.45, "uncertain").when(truth > 0.35, "leans false").when(truth > 0.15, "likely false")
    return out.when(truth.isNotNull(), "very likely false")


def time_of_day(hour: Column) -> Column:
    return F.when(hour.between(5, 11), "morning").when(hour.between(12, 16), "day").when(hour.between(17, 20), "evening").otherwise("night")


def week_start(day: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def merge_windows(spans: Column, limit: int) -> Column:
    """Greedy windows over ascending (s, e) spans: a span joins the window while the whole stays within limit."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce(x["e"] - last["s"] <= limit, F.lit(False))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), x["e"].alias("e"))))
        return F.when(fits, grown).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    return F.aggregate(spans, empty, step)
