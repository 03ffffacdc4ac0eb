"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket (1,024 buckets a level, whatever the corpus' size); the running sum of a
source's buckets shows in which one its budget ends, and only that bucket is cut finer at the next level, until one
hash value is left. Documents are then taken by comparing their hash with the source's threshold: nothing is sorted.
A source whose target is its whole size or more takes all once (or twice) and the threshold decides on one copy
more, so that smaller budgets always take a part of what larger ones take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm._common import prepare, settle

LEVEL_BITS = 10
HASH_BITS = 60
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Plans of up to so many sources are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_COPIES) -> list[float]:
    """Each source's target: its weight's part of the budget, at most `most` times its size, the excess reshared."""
    budget, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        whole = sum(weights[k] for k in open_)
        full = [k for k in open_ if whole <= 0 or budget * weights[k] > most * sizes[k] * whole]
        if not full or whole <= 0:
            for k in open_:
                out[k] = budget * weights[k] / whole if whole > 0 else 0.0
            break
        for k in full:
            out[k] = float(most * sizes[k])
        budget -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def _joined(rows: DataFrame, plan: list[tuple], schema: str) -> DataFrame:
    frame = rows.sparkSession.createDataFrame(plan, schema)
    return rows.join(F.broadcast(frame) if len(plan) <= BROADCAST_SOURCES else frame, rows["source"].eqNullSafe(frame["source_"]))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row: how many of its words the mix takes, repeats counted.
    With `keep` also the whole input row as the struct `row`.

    Sources in code-point order, null last, get the weights in turn. A source's taken words are its target, less at
    most one word for each row on the threshold. Rows with the same id (null ids too) share a hash; where the
    threshold falls on them, each gives the same part of its words. Empty and null texts have size 0 and give
    nothing; if all are empty, all targets are 0. Reruns give the same.

    One row for each source goes to the driver, which holds the weights: sources are the mix's configuration.
    """
    spark = prepare(documents.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *([F.struct("*").alias("row")] if keep else []))
    digest = F.md5(F.concat(F.lit("mix "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("h", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long"))
    rows = settle(rows, "sizes")
    total = sorted(((r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    aims = targets([n for _, n in total], [weights[k % len(weights)] for k in range(len(total))], share, most)
    plan = {}
    for (source, n), aim in zip(total, aims, strict=True):
        whole = min(int(aim // n), most) if n else 0
        plan[source] = {"n": n, "aim": aim, "whole": whole, "rest": aim - whole * n if n else 0.0, "start": 0, "at": -1, "part": 0.0}
    waiting = [s for s, p in plan.items() if p["rest"] > 0]
    for done in range(0, HASH_BITS, LEVEL_BITS):
        if not waiting:
            break
        found = _boundaries(rows, [(s, plan[s]["start"], plan[s]["rest"]) for s in waiting], done)
        still = []
        for r in found:
            p = plan[r["source"]]
            p["rest"] -= r["before"]
            p["start"] = r["low"] >> (HASH_BITS - done - LEVEL_BITS)
            if r["low"] == r["high"]:
                p["at"], p["part"] = r["low"], p["rest"] / r["words"]
            else:
                still.append(r["source"])
        for s in set(waiting) - {r["source"] for r in found}:  # rounding: the budget is the whole source
            plan[s]["at"] = 1 << HASH_BITS
        waiting = still
    decided = [(s, p["n"], p["aim"], p["whole"], p["at"], p["part"]) for s, p in plan.items()]
    out = _joined(rows, decided, "source_ string, source_size bigint, target double, whole bigint, at bigint, part double")
    more = F.when(F.col("h") < F.col("at"), F.col("size")).when(F.col("h") == F.col("at"), F.floor(F.col("part") * F.col("size") + 1e-6)).otherwise(F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.least(more, F.col("size"))).cast("long").alias("taken"), *(["row"] if keep else []))


def _boundaries(rows: DataFrame, wanted: list[tuple], done: int) -> list:
    """For each source the bucket, of those that begin with its first `done` bits, in which the rest of its budget ends."""
    mine = _joined(rows, wanted, "source_ string, start bigint, rest double")
    mine = mine.where(F.shiftright("h", HASH_BITS - done) == F.col("start")) if done else mine
    bucket = F.shiftright("h", HASH_BITS - done - LEVEL_BITS)
    sums = mine.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "rest", "words", "low", "high", before.alias("before"))
    return sums.where("before <= rest AND rest < before + words").collect()


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that the mix takes, once for each whole copy, and once with its first words for a copy in part.

    Columns as given. Rows of which nothing is taken go. Each row is cut by its own size, whatever other rows have its id.
    """
    taken = mix(documents, id_col=id_col, text_col=text_col, keep=True, **options).where("taken > 0")
    rows = taken.select("row", F.col("row").getField(text_col).alias("text"), "size", "taken")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("row", "text", F.explode(copies).alias("words"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0))
    part = F.rtrim(F.array_join(F.slice(words, F.lit(1), F.col("words")), ""))
    text = F.when(F.col("words") == 0, F.col("text")).otherwise(part)
    return rows.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
