"""An index of three-character runs for substring searches (G1-G4, K2, J1), written once and kept with each change."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grams(text: Column) -> Column:
    """The distinct runs of three characters of text, in time linear in its length."""
    c = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    part = lambda k: F.slice(c, k, F.greatest(F.size(c) - 2, F.lit(0)))
    both = lambda a, b: F.concat(a, b)
    return F.array_distinct(F.zip_with(F.zip_with(part(1), part(2), both), part(3), both))


class SubstringIndex:
    """Texts by key in a folder that all executors share.

    Generation n holds what changed in update n: names (key, text; a null text is a deletion),
    postings (gram, key) and counts (gram, n), in a part for each remainder of a gram's or key's crc32
    and sorted there, so that a search reads only the parts, and in them the row groups, of its grams. Names
    are written last and make a generation valid: one that failed is overwritten by the next update.
    Postings of older texts stay until compact; every candidate is held against its key's newest text, so
    results are exact. Case is ignored. Keys are strings, null keys are left out; of equal keys in
    one update the greatest text counts, a deletion only if alone. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder, parts

    def _part(self, c: str) -> Column:
        return F.pmod(F.crc32(F.col(c)), F.lit(self.parts)).cast("int")

    def _store(self) -> tuple:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/names")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path, jvm

    def generations(self) -> list[int]:
        """The valid generations."""
        store, path, jvm = self._store()
        if not store.exists(path):
            return []
        dirs = [f.getPath() for f in store.listStatus(path)]
        return sorted(int(d.getName().split("=")[1]) for d in dirs if d.getName().startswith("gen=") and store.exists(jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))

    def _read(self, table: str, schema: str) -> DataFrame:
        known = self.generations()
        if not known:
            return self.spark.createDataFrame([], f"{schema}, part int, gen int")
        return self.spark.read.schema(f"{schema}, part int, gen int").option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/gen={g}" for g in known])

    def _write(self, names: DataFrame, gen: int) -> None:
        out = lambda df, by, table: df.withColumn("part", self._part(by)).repartition("part").sortWithinPartitions("part", by).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{table}/gen={gen}")
        post = names.where("text is not null").select("key", F.explode(grams(F.lower("text"))).alias("gram"))
        out(post, "gram", "postings")
        written = self.spark.read.schema("key string, gram string, part int").parquet(f"{self.folder}/postings/gen={gen}")
        out(written.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "counts")
        out(names.select("key", "text"), "key", "names")

    def update(self, changed: DataFrame, key: str = "key", text: str = "text") -> int:
        """Write what changed (key, text), null texts being deletions; returns the generation."""
        gen = max(self.generations(), default=-1) + 1
        self._write(changed.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key is not null").groupBy("key").agg(F.max("text").alias("text")), gen)
        return gen

    def _newest(self, names: DataFrame) -> DataFrame:
        return names.groupBy("key").agg(F.max_by(F.struct("text"), "gen").alias("t")).select("key", "t.text").where("text is not null")

    def texts(self) -> DataFrame:
        """(key, text) as of now."""
        return self._newest(self._read("names", "key string, text string"))

    def _of(self, table: str, schema: str, asked: list[str]) -> DataFrame:
        at = sorted({zlib.crc32(g.encode()) % self.parts for g in asked})
        return self._read(table, schema).where(F.col("part").isin(at) & F.col("gram").isin(asked))

    def candidates(self, asked: list[str], rarest: int = 3) -> DataFrame:
        """Keys that have, or had, the rarest of the asked grams."""
        n = {r["gram"]: r["n"] for r in self._of("counts", "gram string, n long", asked).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row per gram of the query
        if len(n) < len(asked):
            return self.spark.createDataFrame([], "key string")
        best = sorted(asked, key=lambda g: (n[g], g))[:rarest]
        found = self._of("postings", "key string, gram string", best)
        return found.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(best)).select("key")

    def search(self, query: str) -> DataFrame:
        """(key, text, position): texts that contain query, and where it first stands, from 0. An empty query is in every text.

        Queries of less than three characters have no gram and scan the texts.
        """
        low = self.spark.range(1).select(F.lower(F.lit(query))).first()[0]
        asked = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        names = self._read("names", "key string, text string")
        if asked:
            names = names.join(self.candidates(asked), "key", "left_semi")
        at = F.locate(low, F.lower("text")) - 1 if low else F.lit(0)
        return self._newest(names).select("key", "text", at.alias("position")).where("position >= 0")

    def compact(self, folder: str) -> SubstringIndex:
        """The same texts as one generation in a new folder."""
        other = SubstringIndex(self.spark, folder, self.parts)
        other.update(self.texts())
        return other
