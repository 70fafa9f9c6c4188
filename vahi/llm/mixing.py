"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vahi.llm.common import BROADCAST_IDS, WHITE, WHITE_RE, clean_text, forget, join_by, stored, tasks

WORD_RE = r"[^\x20\x09-\x0D]+"


def n_words(name: str = "text"):
    """The number of words of a text, counted by replacing each by one character: no array of a long text's words is made."""
    return F.length(F.regexp_replace(F.ltrim(clean_text(name), F.lit(WHITE)), f"{WORD_RE}(?:{WHITE_RE})?", "x")).cast("long")


def _wide(column) -> F.Column:
    return F.col(column).cast("decimal(38,0)") if isinstance(column, str) else column.cast("decimal(38,0)")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(key, source_size, n_rows) of every source with its place, weight and target: a row a source.

    The shares of all words stop at `most` times a source's own size, and what is over goes to the other sources by weight. In order of size over weight the
    sources that stop are the first ones: a source stops if its limit is not above its share of what those before it leave.
    """
    by_key, everything = Window.orderBy("key"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = sizes.withColumn("place", F.row_number().over(by_key).cast("long")).withColumn(
        "weight", F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (F.col("place") - 1).cast("int") % len(weights) + 1)
    )
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "key")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    shared = placed.withColumns({
        "limit": F.col("source_size") * most, "total": F.sum("source_size").over(everything),
    }).withColumns({"limits_before": F.coalesce(F.sum("limit").over(earlier), F.lit(0)), "weights_left": F.sum("weight").over(later)})
    stops = _wide("limit") * _wide("weights_left") <= _wide("weight") * _wide(F.col("total") - F.col("limits_before"))
    shared = shared.withColumn("stops", stops)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))).over(everything), F.lit(0))
    open_weights = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise((F.col("weight") * left).cast("double") / open_weights.cast("double"))
    return shared.select("key", "place", "weight", "source_size", "n_rows", "total", target.alias("target"))


def _with_source(rows: DataFrame, sources: DataFrame, few: bool, total: int) -> DataFrame:
    """rows with their source's columns; many sources are joined by a shuffle that leaves the rows of hot ones where they are."""
    return rows.join(F.broadcast(sources), "key") if few else join_by(rows, sources, "key", "n_rows", total)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, grain: int = 1000, seed: str = "mix") -> DataFrame:
    """How many words a mix takes of each document, so that sources come near their weighted shares of all words.

    The sources, in order of code point and null last, have the weights in turn. A source's documents wait in shuffled order (by the MD5 of seed and doc_id), up to
    `most` times over, in packets of at most 1/grain of the source's target. A packet's virtual finish time is the source's words up to its end over the target;
    all packets are range-sorted by it and taken until the total budget, all words there are, is spent; the packet that passes it is cut. Words before a document
    in its queue, and words before a packet in the mix, come from per-partition totals carried forward, so no source and no mix is one task. Packets that start past
    twice the target are not made, for the budget is spent when virtual time is little over 1: there are at most 2 * grain + most of them for each document's source
    beyond one for each copy of a document.

    Returns one row per input row: doc_id, size, source_size, target, taken. Null and empty texts have size 0 and taken 0. Sources of no words have target 0.
    A null doc_id is written as nothing in the shuffle; rows of one doc_id, source and size are interchangeable. doc_id must be a number or null.
    Very long texts are cut into packets like others. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))  # null sorts last
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), n_words().alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle"), F.monotonically_increasing_id().alias("row"),
    )
    sized = stored(sized, "mix-sizes")
    sources = stored(source_targets(sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, most), "mix-sources")
    n_sources, n_rows, budget = sources.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.max("total"), F.lit(0))).first()
    few = n_sources <= BROADCAST_IDS

    order = ["shuffle", "doc_id", "size", "row"]
    dealt = stored(sized.repartitionByRange(tasks(spark), "key", *order).withColumn("part", F.spark_partition_id()), "mix-queues")
    forget(sized)
    totals = dealt.groupBy("part", "key").agg(F.sum("size").alias("part_words"))  # at most as many rows as partitions and sources
    carried = totals.withColumn("words_before", F.coalesce(F.sum("part_words").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carried = carried.select("part", "key", "words_before")
    inside = Window.partitionBy("part", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    queued = dealt.withColumn("upto", F.sum("size").over(inside)).join(F.broadcast(carried) if few else carried, ["part", "key"])
    queued = stored(queued.select("doc_id", "key", "size", (F.col("words_before") + F.col("upto") - F.col("size")).alias("before")), "mix-queued")
    forget(dealt)

    copies = _with_source(queued.where("size > 0"), sources.select("key", "place", "source_size", "n_rows", "target"), few, n_rows)
    copies = copies.select("place", "size", "target", F.greatest(F.lit(1), F.floor(F.col("target") / grain)).cast("long").alias("quantum"), "before", "source_size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"))
    copies = copies.withColumn("start", F.col("before") + F.col("copy") * F.col("source_size")).where("start < 2 * target")
    count = F.least(F.ceil(F.col("size") / F.col("quantum")), F.ceil((2 * F.col("target") - F.col("start")) / F.col("quantum"))).cast("int")
    packets = copies.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("words", F.least("quantum", F.col("size") - F.col("k") * F.col("quantum")))
    packets = packets.withColumn("upto", F.col("start") + F.col("k") * F.col("quantum") + F.col("words"))
    packets = packets.select((F.col("upto").cast("double") / F.col("target")).alias("finish"), "place", "upto", "words")
    line = ["finish", "place", "upto"]
    sent = stored(packets.repartitionByRange(tasks(spark), *line).withColumn("part", F.spark_partition_id()), "mix-packets")
    sums = sent.groupBy("part").agg(F.sum("words").alias("part_words"))  # one row a partition
    sums = sums.select("part", F.coalesce(F.sum("part_words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sent_before"))
    running = F.sum("words").over(Window.partitionBy("part").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0))
    in_line = sent.withColumn("running", running).join(F.broadcast(sums), "part").withColumn("over", F.greatest(F.lit(0), F.col("sent_before") + F.col("running") - budget))
    served = in_line.where("over < words").groupBy("place").agg(F.max(F.col("upto") - F.col("over")).alias("served"))  # a row a source
    sources = stored(sources.join(served, "place", "left").withColumn("served", F.coalesce("served", F.lit(0))), "mix-served")
    forget(sent)

    out = _with_source(queued, sources.select("key", "source_size", "n_rows", "target", "served"), few, n_rows)
    of_copy = (F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - F.col("before") - k * F.col("source_size"))) for k in range(most))
    return out.select("doc_id", "size", "source_size", "target", sum(of_copy, F.lit(0)).cast("long").alias("taken"))
