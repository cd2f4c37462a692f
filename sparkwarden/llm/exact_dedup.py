"""Exact dedup by a log-structured merge index, in DataFrame operations only.

Each scan task fills memtables; a memtable flushes as a run, a Parquet file of at most MEMTABLE entries (digest, length, id)
sorted by digest, with Parquet's own Bloom filter on the digest. Compaction merges the new runs with what was merged before into
runs of disjoint digests and keeps of each digest the entry that stays (longest original text, then smallest id) and how many
there were. Decisions come from the compacted index: a filter of its digests that occur more than once lets all other rows pass
without a shuffle, and the rest look their digest up. Hits are compared byte by byte; digests that hold different bytes are
grouped anew by the bytes themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm._filters import join_groups, key_filter, maybe_in
from sparkwarden.llm._shared import new_path

#: Entries in a run, at most.
MEMTABLE = 4_000_000


def normalised(text: Column) -> Column:
    """The text without the characters space and U+0009 to U+000D; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _best() -> Column:
    """An entry as a struct that sorts first if it is to stay: longest text, then smallest id (null last), then first row."""
    return F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row_id").alias("row_id"))


def merged(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the entry that stays (`best`) and how many there are; entries come with `best` and `group_size`."""
    return entries.groupBy(*keys).agg(F.sum("group_size").alias("group_size"), F.min("best").alias("best"))


@dataclass
class DigestIndex:
    """An index of digests in the shared folder: runs not yet merged, and the last merged level."""

    spark: SparkSession
    runs: list[str] = field(default_factory=list)
    level: str | None = None

    def _writer(self, df: DataFrame) -> DataFrameWriter:
        writer = df.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.enable.dictionary#digest", "false")
        return writer.option("maxRecordsPerFile", str(MEMTABLE)).option("compression", "zstd")

    def flush(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Write the rows of df as sorted runs; their entries: digest, n_points, id, row_id."""
        path = new_path(self.spark, "digest-runs")
        entries = df.select(
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
            F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row_id"),
        )
        self._writer(entries).parquet(path)
        self.runs.append(path)
        return self.spark.read.parquet(path)

    def compact(self) -> DataFrame:
        """Merge all new runs and the last level into the next level: digest, group_size, best."""
        parts = [self.spark.read.parquet(p).select("digest", F.lit(1).cast("long").alias("group_size"), _best().alias("best")) for p in self.runs]
        if self.level:
            parts.append(self.spark.read.parquet(self.level))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        path = new_path(self.spark, "digest-level")
        self._writer(merged(every, ["digest"])).parquet(path)
        self.runs, self.level = [], path
        return self.spark.read.parquet(path)

    def lookup(self, digest_hex: str) -> DataFrame:
        """The merged entry of one digest; files whose sort order or Bloom filter excludes it aren't read."""
        return self.spark.read.parquet(self.level).where(F.col("digest") == F.lit(bytearray.fromhex(digest_hex)))


def _collided(df: DataFrame, id_col: str, text_col: str, hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Digests under which different bytes meet. Only hits are read again in full; min and max are merged before the shuffle."""
    some = maybe_in(entries, "digest", key_filter(hits, "digest")).where("_sw_maybe")
    pages = key_filter(some, "id")
    again = maybe_in(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", pages).where("_sw_maybe or id is null")
    texts = again.select(normalised(F.col("text")).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    return texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b").select("digest")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: `id_col`, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting [\\x20\\x09-\\x0D]; null counts as empty, and all empty texts are one group.
    The longest original text stays, then the smallest id (null last), then, of wholly repeated rows, any one. An empty table
    gives an empty result; other columns of df are not touched.
    """
    index = DigestIndex(df.sparkSession)
    entries = index.flush(df, id_col, text_col)
    hits = index.compact().where("group_size > 1")
    bad = _collided(df, id_col, text_col, hits, entries).collect()  # SHA-256 collisions: none are known
    marked = maybe_in(entries.withColumn("_sw_key", F.col("digest")), "_sw_key", key_filter(hits, "digest")).drop("_sw_key")
    alone = marked.where("not _sw_maybe").withColumns({"group_size": F.lit(1).cast("long"), "best": _best()})
    found = join_groups(marked.where("_sw_maybe"), hits, "digest", "group_size", entries.count(), "left")
    out = alone.unionByName(found.withColumns({"group_size": F.coalesce("group_size", F.lit(1).cast("long")), "best": F.coalesce("best", _best())}))
    if bad:
        digests = [F.lit(r[0]) for r in bad]
        texts = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"), F.monotonically_increasing_id().alias("row_id"))
        texts = texts.withColumn("digest", F.unhex(F.sha2("norm", 256))).where(F.col("digest").isin(digests))
        anew = merged(texts.select("digest", "norm", F.lit(1).cast("long").alias("group_size"), _best().alias("best")), ["digest", "norm"])
        out = out.drop("_sw_maybe").where(~F.col("digest").isin(digests)).unionByName(texts.join(anew, ["digest", "norm"]).drop("norm"))
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns. Only rows that may share an id with a dropped one are shuffled."""
    decided = exact_dedup(df, id_col, text_col)
    pages = key_filter(decided.where("not kept").select(F.col(id_col).alias("id")), "id")
    marked = maybe_in(df.withColumn("_sw_id", F.col(id_col)), "_sw_id", pages).withColumn("_sw_maybe", F.col("_sw_maybe") | F.col("_sw_id").isNull())
    sure = marked.where("not _sw_maybe").select(*[F.col(f"`{c}`") for c in df.columns])
    kept = decided.where("kept").select(F.col(id_col).alias("_sw_id"), F.col("text_sha256").alias("_sw_sha")).distinct()
    checked = marked.where("_sw_maybe").withColumn("_sw_sha", F.sha2(normalised(F.col(text_col)), 256))
    m, k = checked.alias("m"), kept.alias("k")
    again = m.join(k, F.expr("m._sw_id <=> k._sw_id and m._sw_sha = k._sw_sha"), "left_semi")
    # of repeated rows (same id, same text) the longest stays
    again = again.withColumn("_sw_n", F.char_length(F.coalesce(F.col(text_col), F.lit("")))).groupBy("_sw_id", "_sw_sha").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), "_sw_n").alias("row"))
    return sure.unionByName(again.select("row.*"))


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY pts DESC, doc_id NULLS LAST)
"""
