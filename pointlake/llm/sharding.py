"""Balanced label propagation: documents into shards, linked ones together, counts even.

Documents with equal texts are linked through their group, a star instead of all pairs.
Members of a group are interchangeable, so the labels that propagate are the counts of
each (group, shard): a group's members start dealt over the shards by hash, and in each
round every group wants its members in the shard where most of them are. Between two
shards as many may move one way as the other, and beyond that as many as the quota of
linked documents has room for; they are granted largest gain first. Rounds go on until one
grants nothing or links cut no longer fall; ROUNDS is a safety stop, and is reported. Quotas are worked
out on totals by (from, to, gain, hash part), a table of fixed size. What is granted
moves at once in the counts; no document row is touched until the end.

Then shards are made exactly even (counts at most one apart): a shard that holds too
many linked documents gives the overhang, and that overhang and the unlinked documents,
which no shard prefers, fill the gaps in one line. A document finds its shard and slot by
its rank in its group, made in salted parts, so that neither a group that holds a third
of all rows nor a shard is ever one task's work. Everything is DataFrame operations.

Defined cases: a null text is its own group, apart from the empty text; documents
without a partner are unlinked; repeated rows are members of a group like others; null
ids are rows like others; with fewer rows than shards some shards stay empty; an empty
table gives an empty table; input columns that clash with an output column are
replaced by it.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointlake.llm.common import cut, fresh, quoted, read_table, spent

SHARDS, ROUNDS = 16, 100
#: Parts into which a group's members, the unlinked rows and a shard's groups are dealt for ranking.
SALTS, PARTS = 64, 1024
#: Classes of gain and parts of each by hash, by which a round's quotas are granted.
GAINS, FINE = 40, 64


def _hash(*cols: Column | str, parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(parts)).cast("int")


def _below(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Running total of ``value`` before each row of a small table."""
    past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(past), F.lit(0)))


def cut_links(cells: DataFrame) -> int:
    """Pairs of linked documents whose shards differ, from (g, shard, n)."""
    sums = cells.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return sums.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).cast("long").alias("x")).first().x or 0


def propagated(cells: DataFrame, quotas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (g, shard, n) after moves; ``quotas``: (shard, quota) of linked documents.

    Each round at most brings a shard to its quota; a group whose move is not
    granted stays and asks again, until a round grants nothing or does not lower the
    links cut. What ``rounds`` stops before that is reported as a warning.
    """
    links, given = cut_links(cells), cells
    for _ in range(rounds):
        best = cells.groupBy("g").agg(F.max(F.struct("n", F.xxhash64("g", "shard").alias("tie"), "shard")).alias("b"))
        asked = cells.join(best.select("g", F.col("b.shard").alias("to"), F.col("b.n").alias("most")), "g").where("shard <> to")
        gain = F.least(F.floor(F.log2(F.col("most").cast("double"))), F.lit(GAINS - 1)).cast("int")
        asked = cut(asked.select("g", "shard", "to", "n", (F.lit(GAINS) - gain).alias("gain"), _hash("g", parts=FINE, seed=3).alias("fine")))
        if asked.isEmpty():
            return cells
        held = cells.groupBy("shard").agg(F.sum("n").alias("held"))
        room = quotas.join(held, "shard", "left").select(F.col("shard").alias("to"), F.greatest(F.col("quota") - F.coalesce("held", F.lit(0)), F.lit(0)).alias("room"))
        # as many may go from one shard to another as come back, and beyond that as many as there is room for
        flow = flows = cut(asked.groupBy("shard", "to").agg(F.sum("n").alias("d")))
        back = flows.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("d").alias("e"))
        flows = flows.join(back, ["shard", "to"], "left").withColumn("both", F.least("d", F.coalesce("e", F.lit(0)))).withColumn("more", F.col("d") - F.col("both"))
        flows = _below(flows, ["to"], ["shard"], "more", "past").join(room, "to")
        flows = flows.select("shard", "to", (F.col("both") + F.greatest(F.least(F.col("room") - F.col("past"), F.col("more")), F.lit(0))).alias("room"))
        wanted = _below(asked.groupBy("shard", "to", "gain", "fine").agg(F.sum("n").alias("want")), ["shard", "to"], ["gain", "fine"], "want", "before")
        granted = wanted.join(flows, ["shard", "to"]).select("shard", "to", "gain", "fine", "want", F.greatest(F.least(F.col("room") - F.col("before"), F.col("want")), F.lit(0)).alias("may"))
        # a class that fits moves whole; of one that does not, each cell moves its share, rounded down
        part = asked.join(granted.where("may > 0"), ["shard", "to", "gain", "fine"]).withColumn("go", F.when(F.col("may") >= F.col("want"), F.col("n")).otherwise(F.floor(F.col("n") * F.col("may") / F.col("want")).cast("long"))).where("go > 0")
        out = part.select("g", "shard", (-F.col("go")).alias("n"))
        into = part.select("g", F.col("to").alias("shard"), F.col("go").alias("n"))
        moved = cut(cells.unionByName(out).unionByName(into).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        left = cut_links(moved)
        spent(asked, flow)
        if left >= links:  # nothing granted, or nothing gained
            spent(moved)
            return cells
        if cells is not given:
            spent(cells)
        cells, links = moved, left
    logging.getLogger(__name__).warning("propagation stopped after %d rounds; %d pairs of linked documents are cut", rounds, links)
    return cells


def sharded(df: DataFrame, text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``df`` without ``text_col`` and with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``rows``; ``slot`` is gapless from 0 in each shard. Columns of
    those names are replaced.
    """
    names = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rest = [c for c in df.columns if c.lower() not in {*names, text_col.lower()}]
    row, text = fresh(df, "row"), quoted(text_col)
    group = F.struct(F.xxhash64(text, F.lit(1)).alias("a"), F.xxhash64(text, F.lit(2)).alias("b"), text.isNull().alias("none"))
    rows = cut(
        df.select(
            F.struct(*[quoted(c) for c in rest]).alias(row),
            group.alias("g"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        ).withColumn("salt", _hash(row, parts=SALTS, seed=5))
    )
    parts = cut(rows.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n")))
    groups = cut(parts.groupBy("g").agg(F.sum("n").alias("n")))
    spark = df.sparkSession
    total = groups.agg(F.sum("n").alias("n")).first().n or 0
    even = cut(spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(total // shards) + (F.col("id") < total % shards).cast("long")).alias("quota")))

    linked = groups.where("n > 1").select("g")
    dealt = parts.join(linked, "g").withColumn("shard", _hash("g", "salt", parts=shards, seed=9)).groupBy("g", "shard").agg(F.sum("n").alias("n"))
    cells = propagated(cut(dealt), even, rounds)

    # positions in shards: groups in hash parts, each part's total shifted by those before
    placed = cells.withColumn("part", _hash("g", parts=PARTS, seed=11))
    base = _below(placed.groupBy("shard", "part").agg(F.sum("n").alias("t")), ["shard"], ["part"], "t", "base").drop("t")
    placed = _below(placed, ["shard", "part"], ["g"], "n", "lo").join(base, ["shard", "part"]).join(even, "shard")
    placed = placed.select("g", "shard", "n", (F.col("lo") + F.col("base")).alias("lo"), "quota")
    placed = cut(placed.withColumn("fit", F.greatest(F.least(F.col("n"), F.col("quota") - F.col("lo")), F.lit(0))))
    over = placed.where("fit < n").select("g", "shard", (F.col("n") - F.col("fit")).alias("n"), _hash("g", "shard", parts=PARTS, seed=13).alias("part"))
    # one line: parts of the overhang first, then parts of the unlinked rows
    alone = groups.where("n = 1").select("g", _hash("g", parts=PARTS, seed=17).alias("part"))
    heads = over.groupBy("part").agg(F.sum("n").alias("t")).withColumn("what", F.lit(0)).unionByName(alone.groupBy("part").agg(F.count(F.lit(1)).alias("t")).withColumn("what", F.lit(1)))
    heads = cut(heads.withColumn("past", F.coalesce(F.sum("t").over(Window.orderBy("what", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t"))
    line = _below(over, ["part"], ["g", "shard"], "n", "lo").join(heads.where("what = 0"), "part").select("g", "shard", (F.col("lo") + F.col("past")).alias("line"))
    lone = alone.withColumn("lo", F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1).join(heads.where("what = 1"), "part").select("g", (F.col("lo") + F.col("past")).alias("line"))

    # gaps: which stretch of the line fills which slots; one row a shard, carried as one array
    filled = even.join(placed.groupBy("shard").agg(F.sum("fit").alias("used")), "shard", "left").select("shard", F.coalesce("used", F.lit(0)).alias("used"), (F.col("quota") - F.coalesce("used", F.lit(0))).alias("gap"))
    gaps = sorted(filled.collect(), key=lambda r: r.shard)
    starts, at = [], 0
    for r in gaps:
        starts.append((at, at + r.gap, r.shard, r.used))
        at += r.gap

    def fill(position: Column, what: str) -> Column:
        out = F.lit(None).cast("long")
        for lo, hi, shard, used in reversed(starts):
            if hi > lo:
                value = F.lit(shard).cast("long") if what == "shard" else position - lo + used
                out = F.when(position < hi, value).otherwise(out)
        return out

    # where each group's members go, as stretches of their ranks: at most three a shard
    runs = placed.where("fit > 0").select("g", "shard", F.lit(0).alias("what"), F.col("fit").alias("n"), F.col("lo").alias("first"))
    runs = runs.unionByName(over.join(line, ["g", "shard"]).select("g", "shard", F.lit(1).alias("what"), "n", F.col("line").alias("first")))
    runs = _below(runs, ["g"], ["what", "shard"], "n", "from")
    runs = runs.unionByName(lone.select("g", F.lit(0).alias("shard"), F.lit(1).alias("what"), F.lit(1).cast("long").alias("n"), F.col("line").alias("first"), F.lit(0).cast("long").alias("from")))
    plan = runs.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("from", "n", "what", "shard", "first"))).alias("runs"))
    keyed = _below(parts, ["g"], ["salt"], "n", "before").select("g", "salt", "before").join(plan, "g")
    inside = Window.partitionBy("g", "salt").orderBy(F.xxhash64(row), "size")
    out = rows.withColumn("nth", F.row_number().over(inside) - 1).join(keyed, ["g", "salt"])
    nth = F.col("nth") + F.col("before")
    out = out.withColumn("nth", nth).withColumn("run", F.filter("runs", lambda r: (F.col("nth") >= r["from"]) & (F.col("nth") < r["from"] + r["n"]))[0])
    position = F.col("run.first") + F.col("nth") - F.col("run.from")
    kept = F.col("run.what") == 0
    return out.select(
        *[F.col(row)[c].alias(c) for c in rest],
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(kept, F.col("run.shard").cast("long")).otherwise(fill(position, "shard")).cast("int").alias("shard"),
        F.when(kept, position).otherwise(fill(position, "slot")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
