"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate.

A HyperLogLog sketch of the sites of each line hash merges by aggregation. Lines whose estimate is within BAND of the
threshold get an exact distinct count; the rest are decided by the sketch, whose error at LG_K is far below the band.
Every occurrence of a boilerplate line is removed except its first (smallest doc_id, then text hash, then place), so
no content leaves the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm._common import prepare, settle

MIN_SITES = 10
LG_K = 10
#: Estimates from (1 - BAND) to (1 + BAND) times the threshold are counted exactly: eight standard errors at LG_K.
BAND = 0.25


def _hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value), F.xxhash64(F.lit("line"), value)]


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first of every line on min_sites sites or more; lines: doc_id, t1, t2, place, h1, h2, site."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("spread"), F.min(F.struct("doc_id", "t1", "t2", "place")).alias("first"))
    sketched = settle(sketched.where(F.col("spread") >= int(min_sites * (1 - BAND))), "spread")
    sure = sketched.where(F.col("spread") > min_sites * (1 + BAND))
    near = sketched.where(F.col("spread") <= min_sites * (1 + BAND))
    counted = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
    counted = counted.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2")
    return sure.select("h1", "h2", "first").union(near.join(counted, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def dedup_lines(documents: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row (the input row, boilerplate lines taken out of its text), lines and removed (how many, long).

    Lines end at line feeds; lines of nothing but white space are never boilerplate. A null source is a site of its
    own. Null text stays null (0 lines); a text of boilerplate alone becomes empty; every row is kept. Repeated rows
    are treated alike: the copies of a line's first occurrence all keep it.
    """
    prepare(documents.sparkSession)
    text, source = F.col(text_col), F.col(source_col).cast("string")
    site = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    t1, t2 = _hashes(F.coalesce(text, F.lit("")))
    lines = documents.select(F.col(id_col).alias("doc_id"), t1.alias("t1"), t2.alias("t2"), site.alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    h1, h2 = _hashes(F.col("line"))
    lines = lines.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", "t1", "t2", "place", h1.alias("h1"), h2.alias("h2"), "site")
    lines = settle(lines, "lines")
    common = settle(boilerplate(lines, min_sites), "boilerplate")
    out = lines.join(common, ["h1", "h2"]).where(~F.struct("doc_id", "t1", "t2", "place").eqNullSafe(F.col("first")))
    out = out.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("_out"))
    out = out.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_out")
    rows = documents.select(F.struct("*").alias("row"), t1.alias("k1"), t2.alias("k2"))
    joined = rows.join(out, F.col("row").getField(id_col).eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_t1")) & (F.col("k2") == F.col("_t2")), "left")
    joined = joined.select("row", "_out", F.col("row").getField(text_col).alias("text"))
    split = F.split("text", "\n", -1)
    ends = F.concat(F.array(F.lit(-1)), F.col("_out"), F.array(F.size(split)))
    runs = F.transform(F.sequence(F.lit(0), F.size("_out")), lambda k: F.slice("lines", F.get("ends", k) + 2, F.get("ends", k + 1) - F.get("ends", k) - 1))
    joined = joined.withColumns({"lines": split, "ends": ends})
    kept = F.when(F.col("_out").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    removed = F.coalesce(F.when(F.col("_out").isNotNull(), F.size("_out")), F.lit(0)).cast("long")
    return joined.select(F.col("row").withField(f"`{text_col}`", kept).alias("row"), count.alias("lines"), removed.alias("removed"))
