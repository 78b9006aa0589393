"""Captions and player metadata from raw text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUE = "array<struct<start:double,duration:double,text:string>>"


#: What trimming takes away: white space, no-break spaces, byte order marks.
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


# Two decimal entities that are the halves of one character beyond 65,535.
HALVES = r"&#(5529[6-9]|55[3-9]\d\d|56[0-2]\d\d|563[01]\d);&#(563[2-9]\d|56[4-9]\d\d|57[0-2]\d\d|573[0-3]\d|5734[0-3]);"


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is named: a name inside a lambda is not put in anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode_entities(text: Column) -> Column:
    """The five named entities, then decimal ones of any length; two halves make one character, a lone half U+FFFD.

    Numbers beyond Unicode count modulo 65,536. &#38; comes last, as what it makes is not read again.
    """
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(name), F.lit(char))

    def join(acc: Column, pair: Column) -> Column:
        high, low = F.regexp_extract(pair, HALVES, 1).cast("int"), F.regexp_extract(pair, HALVES, 2).cast("int")
        return F.replace(acc, pair, _char((high - 55296) * 1024 + (low - 56320) + 65536))

    def put(acc: Column, code: Column) -> Column:
        number = code.try_cast("decimal(38,0)")
        number = F.when(number > 1114111, number % 65536).otherwise(number)
        char = F.when(number.between(55296, 57343), F.lit("\ufffd")).otherwise(_char(number))
        return F.coalesce(F.replace(acc, F.concat(F.lit("&#"), code, F.lit(";")), char), acc)

    ampersand = lambda c: c.rlike("^0*38$")

    def decimals(t: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(\d+);"), F.lit(1)))
        return bound(codes, lambda found: F.aggregate(F.concat(F.filter(found, lambda c: ~ampersand(c)), F.filter(found, ampersand)), t, put))

    halves = lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(HALVES), F.lit(0))), t, join)
    return bound(text, lambda t: F.when(F.contains(t, F.lit("&#")), bound(halves(t), decimals)).otherwise(t))


def timed_text_cues(rows: DataFrame, column: str = "xml") -> DataFrame:
    """Rows with (cue_idx, start, duration, text) of timed text in either shape; the second counts only where the first yields none."""
    new, old = r'<p\s+t="\d+"\s+d="\d+"[^>]*>(?s:.*?)</p>', r"<text\s+[^>]*>(?s:.*?)</text>"
    # each of these texts is one match as a whole, so that what it holds lies between its first > and the closing tag
    inside = lambda e, tag: bound(F.instr(e, ">"), lambda at: F.substring(e, at + 1, F.length(e) - at - len(f"</{tag}>")))

    def modern(p: Column) -> Column:
        said = lambda inner: bound(F.array_join(F.regexp_extract_all(inner, F.lit(r"<s[^>]*>([^<]*)</s>"), F.lit(1)), ""), lambda s: F.when(s != "", s).otherwise(F.regexp_replace(inner, r"<[^>]+>", "")))
        text = bound(inside(p, "p"), said)
        at = lambda group: F.regexp_extract(p, r'^<p\s+t="(\d+)"\s+d="(\d+)"', group).cast("double") / 1000
        return F.struct(at(1).alias("start"), at(2).alias("duration"), _trimmed(decode_entities(text)).alias("text"))

    def legacy(t: Column) -> Column:
        text = decode_entities(F.regexp_replace(inside(t, "text"), r"<[^>]+>", ""))
        start = lambda attrs: F.regexp_extract(attrs, r'start="([^"]+)"', 1).try_cast("double")
        dur = lambda attrs: F.coalesce(F.nullif(F.regexp_extract(attrs, r'dur="([^"]+)"', 1), F.lit("")).try_cast("double"), F.lit(0.0))
        return bound(F.regexp_extract(t, r"^<text\s+([^>]*)>", 1), lambda attrs: F.struct(start(attrs).alias("start"), dur(attrs).alias("duration"), text.alias("text")))

    first = F.filter(F.transform(F.regexp_extract_all(F.col(column), F.lit(new), F.lit(0)), modern), lambda c: c["text"] != "")
    second = F.filter(F.transform(F.regexp_extract_all(F.col(column), F.lit(old), F.lit(0)), legacy), lambda c: (_trimmed(c["text"]) != "") & c["start"].isNotNull())
    cues = bound(first, lambda n: F.when(F.size(n) > 0, n).otherwise(second))
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(cues).alias("cue_idx", "c")).select("*", "c.*").drop("c")


def event_cues(rows: DataFrame, column: str = "json") -> DataFrame:
    """Rows with (cue_idx, start, duration, text) of JSON caption events; blank ones and unreadable JSON give none."""
    body = F.from_json(F.col(column), "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>")

    def cue(e: Column) -> Column:
        said = F.array_join(F.transform(F.coalesce(e["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
        return F.struct((e["tStartMs"] / 1000).alias("start"), (F.coalesce(e["dDurationMs"], F.lit(0.0)) / 1000).alias("duration"), _trimmed(F.translate(said, "\n", " ")).alias("text"))

    cues = F.filter(F.transform(body["events"], cue), lambda c: (c["text"] != "") & c["start"].isNotNull())
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(cues).alias("cue_idx", "c")).select("*", "c.*").drop("c")


def page_state(rows: DataFrame, column: str = "html") -> DataFrame:
    """Rows with state (ok, login-required, removed, no-captions) and tracks of a player page."""
    html = F.coalesce(F.col(column), F.lit(""))
    status = F.regexp_extract(html, r'"playabilityStatus"\s*:\s*\{\s*"status"\s*:\s*"([^"]+)"', 1)
    listed = F.from_json(F.regexp_extract(html, r'"captionTracks":(\[[^\]]*\])', 1), "array<struct<languageCode:string,kind:string,baseUrl:string>>")
    login = status.isin("LOGIN_REQUIRED", "AGE_VERIFICATION_REQUIRED", "CONTENT_CHECK_REQUIRED") | ((status == "") & html.rlike(r'"status"\s*:\s*"LOGIN_REQUIRED"'))
    state = F.when(login, "login-required").when(status.isin("ERROR", "UNPLAYABLE"), "removed").when(F.coalesce(F.size("_t"), F.lit(0)) <= 0, "no-captions").otherwise("ok")
    track = lambda t: F.struct(F.coalesce(t["languageCode"], F.lit("en")).alias("language"), F.when(t["kind"] == "asr", "auto").otherwise("manual").alias("kind"), F.coalesce(t["baseUrl"], F.lit("")).alias("base_url"))
    out = rows.withColumn("_t", listed).withColumn("state", state)
    return out.withColumn("tracks", F.when(F.col("state") == "ok", F.transform("_t", track)).otherwise(F.array().cast("array<struct<language:string,kind:string,base_url:string>>"))).drop("_t")


def pick_track(tracks: Column, language: str = "en") -> Column:
    """Of an array of tracks: manual in the language, automatic in it, any manual, else the first; null for none."""
    first = lambda *conds: F.get(F.filter(tracks, conds[0]), F.lit(0))
    mine = lambda t, kind: (t["kind"] == kind) & t["language"].startswith(language)
    return F.coalesce(first(lambda t: mine(t, "manual")), first(lambda t: mine(t, "auto")), first(lambda t: t["kind"] == "manual"), F.get(tracks, F.lit(0)))


def player_metadata(rows: DataFrame, column: str = "player") -> DataFrame:
    """Rows with the metadata of nested player JSON: owner name before author, the widest thumbnail."""
    detail = "title:string,author:string,channelId:string,shortDescription:string,keywords:array<string>,lengthSeconds:string,viewCount:string,isLiveContent:boolean,thumbnail:struct<thumbnails:array<struct<url:string,width:int>>>"
    micro = "uploadDate:string,publishDate:string,category:string,ownerChannelName:string"
    body = F.from_json(F.col(column), f"videoDetails struct<{detail}>, microformat struct<playerMicroformatRenderer:struct<{micro}>>")
    rows = rows.withColumn("_b", body).drop(column)
    vd, mf = F.col("_b.videoDetails"), F.col("_b.microformat.playerMicroformatRenderer")
    thumbs = F.transform(vd["thumbnail"]["thumbnails"], lambda t, i: F.struct(F.coalesce(t["width"], F.lit(0)).alias("w"), (-i).alias("first"), t["url"].alias("url")))
    return rows.withColumns({
        "title": vd["title"], "channel": F.coalesce(mf["ownerChannelName"], vd["author"]), "channel_id": vd["channelId"], "description": vd["shortDescription"], "keywords": vd["keywords"],
        "category": mf["category"], "upload_date": mf["uploadDate"], "publish_date": mf["publishDate"], "length_seconds": vd["lengthSeconds"].try_cast("long"), "view_count": vd["viewCount"].try_cast("long"),
        "thumbnail_url": F.array_max(thumbs)["url"], "is_live": vd["isLiveContent"],
    }).drop("_b")


#: Metadata that the richer source decides where it has it; all other fields the other source decides.
RICH = ("title", "channel", "description", "keywords", "view_count", "length_seconds", "thumbnail_url")


def merge_metadata(rich: DataFrame, web: DataFrame, rich_fields: tuple[str, ...] = RICH) -> DataFrame:
    """One row per video_id of either source, field by field: rich_fields from rich where set, all others from web where set."""
    fields = [c for c in rich.columns if c != "video_id"]
    j = rich.select("video_id", *[F.col(c).alias(f"_r_{c}") for c in fields]).join(web.select("video_id", *[F.col(c).alias(f"_w_{c}") for c in fields if c in web.columns]), "video_id", "full")
    pick = {c: F.coalesce(*([f"_r_{c}", f"_w_{c}"] if c in rich_fields else [f"_w_{c}", f"_r_{c}"])) if c in web.columns else F.col(f"_r_{c}") for c in fields}
    return j.select("video_id", *[v.alias(c) for c, v in pick.items()])


def needs_metadata(catalog: DataFrame, fields: tuple[str, ...] = ("upload_date",)) -> DataFrame:
    """Fetched rows without one of the fields."""
    return catalog.where((F.col("status") == "fetched") & F.array_contains(F.array(*[F.col(f).isNull() for f in fields]), True))


def sync_metadata(catalog: DataFrame, fresh: DataFrame, fields: list[str], only_when_empty: tuple[str, ...] = ()) -> DataFrame:
    """Catalogue rows patched with fresh values that are set and differ, and outcome (updated, unchanged, missing).

    Fields of only_when_empty are patched only where the catalogue has nothing. A row without
    fresh values is missing. Counting outcomes without writing is the dry run.
    """
    j = catalog.join(fresh.select("video_id", F.lit(True).alias("_seen"), *[F.col(f).alias(f"_{f}") for f in fields]), "video_id", "left")

    def changes(f: str) -> Column:
        empty = F.col(f).isNull() | (F.col(f).cast("string") == "")
        return F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)) & (empty if f in only_when_empty else F.lit(True))

    any_change = F.array_contains(F.array(*[changes(f) for f in fields]), True)
    out = j.withColumn("outcome", F.when(F.col("_seen").isNull(), "missing").when(any_change, "updated").otherwise("unchanged"))
    return out.withColumns({f: F.when(changes(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop("_seen", *[f"_{f}" for f in fields])
