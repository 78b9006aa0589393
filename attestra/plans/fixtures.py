"""Evidence-graph tables derived from the sample tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREDICATES = ["works_for", "allied_with", "opposed_by", "accused_of", "denies", "endorses", "located_in"]
KINDS = ["empirical", "historical", "speculative", "opinion", "definitional"]
DEPENDENCIES = ["supports", "contradicts", "presupposes", "elaborates"]
LABELS = ["person", "organization", "location", "event", "facility", "technology"]
PREFIXES = ["[logical] ", "[debunks] ", "[alternative] ", "[undercuts] ", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with one row per (l_orderkey, l_linenumber); an order's lines are in one partition."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").repartition("l_orderkey").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


LI = "li as (select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) rn from lineitem) where rn = 1)"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("cue_idx", "text"))
    return d.select("video_id", "cue_idx", (F.col("cue_idx") * 4.0).alias("start"), F.lit(4.0).alias("duration"), "text")


CUES = "cues as (select 'd' || doc_id video_id, (i - 1)::int cue_idx, (i - 1) * 4.0::double as start, 4.0::double duration, w[i] as text from (select doc_id, w, unnest(range(1, len(w) + 1)) i from (select doc_id, string_split(text, chr(10)) w from documents)))"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words as mentions; label by length."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{3,11}"), F.lit(0))).alias("ordinal", "surface"))
    return d.withColumn("label", _pick(LABELS, F.length("surface")))


MENTIONS = f"mentions as (select 'd' || doc_id video_id, (i - 1)::int ordinal, w[i] surface, {_sql_list(LABELS)}[1 + length(w[i]) % 6] as label from (select doc_id, w, unnest(range(1, len(w) + 1)) i from (select doc_id, regexp_extract_all(text, '[A-Z][a-z]{{3,11}}') w from documents)))"


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cs = (F.col("l_linenumber") * 100).cast("int")
    r = j.select(
        F.concat(F.lit("person:c"), "o_custkey").alias("subject_id"), _pick(PREDICATES, F.col("l_partkey")).alias("predicate"), F.concat(F.lit("organization:s"), "l_suppkey").alias("object_id"),
        F.concat(F.lit("v"), F.col("l_orderkey") % 500).alias("transcript_id"), cs.alias("char_start"), (cs + 80).alias("char_end"), (F.col("l_linenumber") * 4.0).alias("time_start"),
        F.round(1 - F.col("l_discount"), 4).alias("confidence"), F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "R", F.round(F.abs("l_tax") * 10, 4)).alias("direct_truth"),
        F.when(F.col("l_linestatus") == "O", "nlp").otherwise("ai").alias("provenance"),
    )
    return r.withColumn("rel_id", F.concat_ws("|", "subject_id", "predicate", "object_id", F.concat("transcript_id", F.lit(":"), "char_start", F.lit("-"), "char_end")))


REL = f"""rel as (select *, subject_id || '|' || predicate || '|' || object_id || '|' || transcript_id || ':' || char_start || '-' || char_end rel_id from (
  select 'person:c' || o_custkey subject_id, {_sql_list(PREDICATES)}[1 + l_partkey % 7] predicate, 'organization:s' || l_suppkey object_id, 'v' || (l_orderkey % 500) transcript_id,
  l_linenumber * 100 char_start, l_linenumber * 100 + 80 char_end, l_linenumber * 4.0::double time_start, round(1 - l_discount, 4) confidence,
  case l_returnflag when 'A' then 0.0::double when 'R' then round(abs(l_tax) * 10, 4) end direct_truth, case l_linestatus when 'O' then 'nlp' else 'ai' end provenance
  from lineitem join orders on l_orderkey = o_orderkey))"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = lines(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    video = F.concat(F.lit("v"), F.col("l_orderkey") % 500)
    tax = F.abs("l_tax") * 10
    return j.select(
        video.alias("video_id"), F.concat(video, F.lit(":c_"), "l_orderkey", F.lit("_"), "l_linenumber").alias("claim_id"), F.array(F.concat(F.lit("thing:p"), "l_partkey"), F.concat(F.lit("organization:s"), "l_suppkey")).alias("entities"),
        _pick(KINDS, F.col("l_partkey")).alias("kind"), F.concat("p_name", F.lit(" "), "p_type").alias("text"), F.round(1 - F.col("l_discount"), 4).alias("confidence"),
        F.when(F.col("l_returnflag") == "A", F.round(tax, 4)).when(F.col("l_returnflag") == "R", F.round(1 - tax, 4)).alias("truth"),
        F.when(F.col("l_returnflag") == "A", "asserts").when(F.col("l_returnflag") == "R", "denies").otherwise("uncertain").alias("stance"), F.col("l_shipdate").cast("date").alias("published"), "l_orderkey", "l_linenumber",
    )


CLAIMS = f"""claims as (select 'v' || (l_orderkey % 500) video_id, 'v' || (l_orderkey % 500) || ':c_' || l_orderkey || '_' || l_linenumber claim_id, ['thing:p' || l_partkey, 'organization:s' || l_suppkey] entities,
  {_sql_list(KINDS)}[1 + l_partkey % 5] kind, p_name || ' ' || p_type as text, round(1 - l_discount, 4) confidence,
  case l_returnflag when 'A' then round(abs(l_tax) * 10, 4) when 'R' then round(1 - abs(l_tax) * 10, 4) end truth,
  case l_returnflag when 'A' then 'asserts' when 'R' then 'denies' else 'uncertain' end stance, l_shipdate::date published, l_orderkey, l_linenumber from li join part on l_partkey = p_partkey)"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line n of an order depends on line n - 1."""
    li = lines(spark, sf_dir)
    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))  # numbers of an order are distinct
    video = F.concat(F.lit("v"), F.col("l_orderkey") % 500)
    kind = _pick(DEPENDENCIES, F.col("l_partkey"))
    j = li.withColumn("_before", before).where(F.col("_before") == F.col("l_linenumber") - 1)
    return j.select(
        video.alias("video_id"), F.concat(video, F.lit(":c_"), "l_orderkey", F.lit("_"), "l_linenumber").alias("source"), F.concat(video, F.lit(":c_"), "l_orderkey", F.lit("_"), F.col("l_linenumber") - 1).alias("target"),
        kind.alias("kind"), F.concat(F.when(kind == "contradicts", _pick(PREFIXES, F.col("l_suppkey"))).otherwise(""), F.lit("because")).alias("rationale"),
    )


DEPS = f"""deps as (select 'v' || (a.l_orderkey % 500) video_id, 'v' || (a.l_orderkey % 500) || ':c_' || a.l_orderkey || '_' || a.l_linenumber source, 'v' || (a.l_orderkey % 500) || ':c_' || a.l_orderkey || '_' || (a.l_linenumber - 1) target,
  {_sql_list(DEPENDENCIES)}[1 + a.l_partkey % 4] kind, (case when {_sql_list(DEPENDENCIES)}[1 + a.l_partkey % 4] = 'contradicts' then {_sql_list(PREFIXES)}[1 + a.l_suppkey % 5] else '' end) || 'because' rationale
  from li a join li b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber + 1)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.concat(F.lit("v"), "o_orderkey").alias("video_id"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("title"), F.col("o_orderpriority").alias("channel"),
        F.when(F.col("o_orderstatus") == "F", "fetched").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed-needs-user").alias("status"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date")).alias("published"), F.when(F.col("o_orderkey") % 5 == 0, "timed out").alias("last_error"), (F.col("o_orderkey") % 3 != 0).alias("has_transcript"),
    )


CATALOG = """catalog as (select 'v' || o_orderkey video_id, c_name || ' ' || c_mktsegment title, o_orderpriority channel, case o_orderstatus when 'F' then 'fetched' when 'O' then 'pending' else 'failed-needs-user' end status,
  case when o_orderkey % 9 <> 0 then o_orderdate::date end published, case when o_orderkey % 5 = 0 then 'timed out' end last_error, o_orderkey % 3 <> 0 has_transcript from orders join customer on o_custkey = c_custkey)"""
