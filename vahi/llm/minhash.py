"""Near-duplicate documents from bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import LOWER, by_ids, chunks, distinct, join_by, raw, run_hashes, stored, text_key, word_hashes
from vahi.llm.components import components, with_links

SHINGLE, K = 5, 64
#: Links have Jaccard similarity of at least PERCENT / 100.
PERCENT = 85
#: The share of links right at the threshold that a sketch may lose: the exact binomial tail beyond the cut-off is below it. Links above the threshold are lost far less.
MISSED = 1e-6
#: Standard deviations by which the place of a shared value may miss what sizes lead to expect.
SLACK = 6.0
#: Longer inverted lists are worked through by stars, on full sets.
LONG_LIST = 40


def least_shared(union: int, percent: int, missed: float = MISSED) -> int:
    """The largest c such that a link's union sketch of this size shares fewer than c values with a probability of at most `missed`."""
    j, below = percent / 100, 0.0
    for c in range(union + 1):
        below += comb(union, c) * j**c * (1 - j) ** (union - c)
        if below > missed:
            return c
    return union


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle, no words none."""
    words, text = word_hashes(LOWER[data], bounds)
    first = np.searchsorted(text, np.arange(len(bounds)))
    grams = run_hashes(words, np.arange(max(0, len(words) - shingle + 1)), shingle)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield distinct(grams[a : b - shingle + 1])
        else:
            yield run_hashes(words[a:b], np.zeros(1, np.int64), b - a) if b > a else grams[:0]


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in chunks(batches, "text"):
        yield part, list(shingle_sets(*raw(part.column("text")), shingle))


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64))


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def sketches(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, n, digest, sketch): the set's size, a digest equal for equal sets (null for the empty set), and its k smallest hashes without their last bit, which are never negative."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, shingle):
            columns = [part.column("doc_id"), part.column("text_key"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) for x in sets], pa.binary()), _longs([x[:k] >> np.uint64(1) for x in sets])]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "n", "digest", "sketch"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(sketch, "doc_id long, text_key long, n long, digest binary, sketch array<long>")


def _checked(pairs: DataFrame, sets: DataFrame, column: str, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """The pairs (a, b) whose arrays in sets pass keep; all in Spark's own expressions, a pair at a time."""
    a = sets.select(F.col("node").alias("a"), F.col(column).alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(a, "a").join(b, "b").where(keep(F.col("of_a"), F.col("of_b"))).select("a", "b")


def is_link(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether two arrays of distinct values are as similar as asked; sizes too far apart are not intersected."""
    x, y = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.least(x, y) * 100 >= F.greatest(x, y) * percent, shared * 100 >= (x + y - shared) * percent).otherwise(F.lit(False))


def may_link(a: Column, b: Column, k: int, percent: int = PERCENT) -> Column:
    """Whether the union's sketch allows a link: of the k smallest values of both, enough are in both. Sketches that are whole sets decide exactly."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    n = F.size(union)
    cut = F.array(*[F.lit(least_shared(u, percent)) for u in range(1, k + 1)])
    whole = (F.size(a) < k) & (F.size(b) < k)
    return F.when(whole, is_link(a, b, percent)).otherwise(shared >= F.element_at(cut, n))


def _ranked(values: DataFrame, size: str) -> DataFrame:
    """values (value, node, n) with each value's number of nodes (df) and its rank in the node's values from rare to common; only values of two nodes or more.

    Values that one node alone holds come first and need no row: their number is the set's or sketch's size less the shared ones.
    """
    counts = stored(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "value-counts")
    total = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    shared = join_by(values, counts, "value", "df", total).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("list"))
    return shared.select("node", "n", F.posexplode("list").alias("at", "x"), (F.expr(size) - F.size("list")).alias("alone")).select(
        "node", "n", F.col("x.value").alias("value"), F.col("x.df").alias("df"), (F.col("alone") + F.col("at")).alias("rank")
    )


def _as_pairs(met: DataFrame) -> DataFrame:
    """The distinct (a, b), a < b, of rows that met with x_node and node."""
    return met.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def _labels_with_long_lists(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(node, component) by the known links and those among the nodes of long lists; no two linked nodes are left in different components.

    On full sets the prefix bound is exact: of two linked sets, each in the order from rare to common, some value lies in both prefixes and enough values
    follow it in both. In each value's list all nodes are compared with one pivot, then those not in its component with another pivot of theirs;
    after that only nodes outside the list's main component are compared with the rest of the list, in other components.
    """
    j = percent / 100
    values = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("value"))
    rows = _ranked(values, "n").where(f"rank <= n - ceil({j} * n - 1e-9)").select("value", "node", "n", "rank", "df")
    rows = stored(rows, "long-lists")
    total = rows.count()
    bound = f"least(x_n - x_rank, n - rank) >= {j / (1 + j)} * (x_n + n) - 1e-9 AND least(x_n, n) >= {j} * greatest(x_n, n) - 1e-9"
    exact = lambda met: stored(_checked(stored(_as_pairs(met.where(bound)), "pairs"), sets, "set", lambda x, y: is_link(x, y, percent)), "links")

    def pivots(some: DataFrame) -> DataFrame:
        """One node of each value's list, and how many rows the list has at most."""
        best = some.groupBy("value").agg(F.min(F.struct("rank", "node", "n", "component")).alias("p"), F.max("df").alias("df"))
        return best.select("value", F.col("p.rank").alias("x_rank"), F.col("p.node").alias("x_node"), F.col("p.n").alias("x_n"), F.col("p.component").alias("x_component"), F.col("df").alias("x_df"))

    label, left = None, rows.withColumn("component", F.col("node"))
    for _ in range(2):
        links = exact(join_by(left, pivots(left), "value", "x_df", total).where("x_node <> node"))
        label = with_links(label, links) if label is not None else components(known.unionByName(links))
        labelled = stored(rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "long-lists")
        left = stored(join_by(labelled, pivots(labelled), "value", "x_df", total).where("component <> x_component").select(*labelled.columns), "left")
    x = left.select("value", F.col("rank").alias("x_rank"), F.col("node").alias("x_node"), F.col("n").alias("x_n"), F.col("component").alias("x_component"))
    return with_links(label, exact(x.join(labelled, "value").where("x_component <> component")))


def near_duplicates(docs: DataFrame, k: int = K, shingle: int = SHINGLE, percent: int = PERCENT, long_list: int = LONG_LIST) -> DataFrame:
    """Link documents whose sets of word shingles have a Jaccard similarity of at least percent / 100, and find the components.

    Equal sets collapse to one node first, so copies are never paired. Each node keeps the k smallest values of one hash function. In the order from rare to
    common, linked nodes share a value among the first few of their sketches and enough of what follows, so only those meet in inverted lists. Short lists give
    their pairs; nodes that stand in long lists are handled by stars on full sets, which pairs nothing within a component. The sketch of the union filters pairs,
    and the full sets of 64-bit shingle hashes confirm every link. A link right at the threshold is lost by its sketch less than once in 1 / MISSED times.
    Ids are broadcast only up to a fixed number.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), text_key (tells rows of one doc_id apart).
    Null and empty texts have no shingles and no links. Rows with a null doc_id link to nothing, have a null component_id and are kept. Rows that repeat a doc_id stand
    each for its own text. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", text_key())
    every = stored(sketches(docs, k, shingle), "sketches")
    grouped = every.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once: the table is what all others read

    j = percent / 100
    least = max(1, least_shared(k, percent))  # values that two linked sketches of k share at least
    needed = f"CASE WHEN n <= {int(j * k)} THEN ceil({j} * n - 1e-9) ELSE {min(least, int(j * k))} END"
    values = nodes.select("node", "n", F.explode("sketch").alias("value"))
    rows = _ranked(values, f"least(n, {k})").where(f"rank <= least(n, {k}) - ({needed})")
    rows = stored(rows.select("value", "node", "n", "rank", "df"), "prefixes")
    size = f"least(least(x_n, {k}) - x_rank, least(n, {k}) - rank)"
    share = f"({j / (1 + j)} * (x_n + n) / greatest(x_n, n))"
    bound = (
        f"least(x_n, n) >= {j} * greatest(x_n, n) - 1e-9 AND {size} >= CASE WHEN greatest(x_n, n) <= {k} THEN {j / (1 + j)} * (x_n + n) - 1e-9 "
        f"ELSE {k} * {share} - {SLACK} * sqrt({k} * {share} * (1 - least(1, {share}))) - 1 END"
    )
    short = rows.where(F.col("df") <= long_list)  # so no list gives more than long_list ** 2 pairs
    x = short.select("value", F.col("node").alias("x_node"), F.col("n").alias("x_n"), F.col("rank").alias("x_rank"))
    pairs = stored(_as_pairs(x.join(short, "value").where("x_node < node").where(bound)), "pairs")
    ends = lambda p: p.select(F.col("a").alias("node")).unionByName(p.select(F.col("b").alias("node")))
    some = by_ids(nodes.select("node", "sketch"), stored(ends(pairs).distinct(), "met"), "node")
    pairs = stored(_checked(pairs, some, "sketch", lambda x, y: may_link(x, y, k, percent)), "pairs")

    hot = stored(rows.where(F.col("df") > long_list).select("node").distinct(), "hot")
    asked = stored(ends(pairs).unionByName(hot).distinct().join(nodes.select("node", "digest", "first_id"), "node"), "asked")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, shingle):
            yield pa.record_batch([pa.array([_digest(x) for x in sets], pa.binary()), _longs(sets)], names=["digest", "set"])

    texts = by_ids(docs.select(F.col("doc_id").alias("first_id"), "text"), asked.select("first_id").distinct(), "first_id")
    sets = texts.mapInArrow(full, "digest binary, set array<long>").join(asked.select("digest", "node"), "digest").select("node", "set")
    sets = stored(sets.groupBy("node").agg(F.first("set").alias("set")), "sets")  # rows may repeat an id
    links = stored(_checked(pairs, sets, "set", lambda x, y: is_link(x, y, percent)), "links")
    label = _labels_with_long_lists(by_ids(sets, hot, "node"), links, percent) if hot.head(1) else components(links)
    label = stored(label.join(nodes.select("node", "first_id"), "node"), "labels")
    smallest = stored(label.groupBy("component").agg(F.min("first_id").alias("found"), F.count("*").alias("in_it")), "smallest")
    named = join_by(label.select("node", "component"), smallest, "component", "in_it", label.count()).select("node", "found")
    found = nodes.select("digest", "node", "first_id", "copies").join(named, "node", "left").select("digest", "copies", F.coalesce("found", "first_id").alias("found"))
    found = stored(found, "components")
    out = join_by(every.where("digest is not null"), found, "digest", "copies", every.count(), "left").select("doc_id", "text_key", "n", "found")
    out = out.unionByName(every.where("digest is null").select("doc_id", "text_key", "n", F.lit(None).cast("long").alias("found")))
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.lit(True)).alias("kept"), "text_key")
