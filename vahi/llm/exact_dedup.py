"""Exact dedup of batches against immutable snapshots screened by binary-fuse filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm import fuse_filter
from vahi.llm.common import WHITE_RE, clean_text, join_by, stored

#: Distinct texts that one filter, and one task that builds or probes it, handles.
BUCKET_KEYS = 50_000


def normalised(text):
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text, WHITE_RE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the SHA-256 of the normalised text, 32 bytes."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(clean_text()), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row a digest, summed before the shuffle: the smallest id that is not null, and the number of rows."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def _keys(digest: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in digest.to_pylist()), "<u8")


def _build(group: pa.Table) -> pa.Table:
    digest = group.column("digest").combine_chunks()
    seed, packed = fuse_filter.build(_keys(digest))
    return pa.table({"bucket": group.column("bucket")[:1], "seed": [seed], "packed": [packed]}, pa.schema([("bucket", pa.int32()), ("seed", pa.int32()), ("packed", pa.binary())]))


def _probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
    out = rows.select(["digest", "keep_id", "n"])
    if not rows.num_rows or not filters.num_rows:
        return out.slice(0, 0)
    digest = rows.column("digest").combine_chunks()
    return out.filter(pa.array(fuse_filter.might_hold(_keys(digest), filters.column("seed")[0].as_py(), filters.column("packed")[0].as_py())))


class Snapshot:
    """An immutable set of distinct normalised texts: exact buckets (digest, keep_id, n, body) and a fuse filter for each bucket.

    Both are tables in the shared folder. A bucket has about BUCKET_KEYS distinct digests of the snapshot or of the largest batch to come (`batch`), so its filter is
    built and probed in tasks of bounded size; copies never share a bucket row, for they are summed to one row a digest first.
    """

    def __init__(self, docs: DataFrame, batch: int = 0):
        self.groups = stored(grouped(digests(docs)), "snapshot-groups")
        self.buckets = max(self.groups.count(), batch) // BUCKET_KEYS + 1
        kept = self.groups.select("digest", F.col("keep_id").alias("doc_id"), "keep_id", "n")
        bodies = docs.select("doc_id", normalised(clean_text()).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
        self.exact = stored(bodies.join(kept, ["doc_id", "digest"]).dropDuplicates(["digest"]).select("digest", "keep_id", "n", "body"), "snapshot")
        self.filters = stored(
            self.groups.select(_bucket(self.buckets), "digest").groupBy("bucket").applyInArrow(_build, "bucket int, seed int, packed binary"), "snapshot-filters"
        )

    def screen(self, groups: DataFrame) -> DataFrame:
        """Those of the digests that the filters may hold. Each bucket's digests meet its filter in one task."""
        incoming = groups.select(_bucket(self.buckets), "digest", "keep_id", "n").groupBy("bucket")
        return incoming.cogroup(self.filters.groupBy("bucket")).applyInArrow(_probe, groups.select("digest", "keep_id", "n").schema)

    def held(self, docs: DataFrame, positives: DataFrame) -> DataFrame:
        """Of the screened digests those whose text equals the snapshot's byte for byte: (digest, keep_id and n of the snapshot, more: n of the batch)."""
        asked = positives.select("digest", F.col("keep_id").alias("doc_id"), F.col("n").alias("more"))
        texts = docs.select("doc_id", normalised(clean_text()).alias("said")).withColumn("digest", F.unhex(F.sha2("said", 256)))
        x, y = texts.alias("x"), asked.alias("y")
        mine = x.join(y, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.digest") == F.col("y.digest"))).select("x.digest", "x.said", "y.more").dropDuplicates(["digest"])
        return mine.join(self.exact, "digest").where(F.col("said") == F.col("body")).select("digest", "keep_id", "n", "more")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Find equal texts (white space runs count as one space); of equals the row with the smallest doc_id stays.

    The lower half of the rows by id makes the snapshot, the upper half and rows without an id come as a batch: its digests are grouped (duplicates within the batch
    meet here), screened by the snapshot's filters, and only the few that pass are joined with the exact buckets, where the bytes are compared. Only what
    passes both joins a group of the snapshot; all other digests of the batch make groups of their own.
    Text is shuffled only to fill the snapshot and for that comparison.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty. Repeated rows of one doc_id all count
    in group_size, and all have kept true if theirs is the smallest id; rows with a null doc_id are counted, and kept only if the group has no others (keep_id is then null).
    An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = docs.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]  # about the middle row, however uneven the ids are; any cut gives the same result
    old = F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(False))
    all_digests = stored(digests(docs).withColumn("old", old), "digests")
    batch = stored(grouped(all_digests.where("NOT old")), "batch-groups")
    snapshot = Snapshot(docs.where(old), batch.count())
    held = stored(snapshot.held(docs.where(~old), snapshot.screen(batch)), "batch-held")
    met = held.select("digest", F.col("keep_id").alias("held_id"), F.col("n").alias("held_n"), "more")
    ours = snapshot.groups.join(met.select("digest", "more"), "digest", "left").select(F.lit(True).alias("old"), "digest", "keep_id", F.col("n").alias("rows"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    theirs = batch.join(met, "digest", "left").select(F.lit(False).alias("old"), "digest", F.when(F.col("more").isNotNull(), F.col("held_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.col("n").alias("rows"), (F.col("n") + F.coalesce("held_n", F.lit(0))).alias("n"))
    side = F.concat(F.col("digest"), F.when(F.col("old"), F.lit(b"\x01")).otherwise(F.lit(b"\x00"))).alias("side")
    groups = stored(ours.unionByName(theirs).select(side, "keep_id", "rows", "n"), "groups")
    out = join_by(all_digests.select("doc_id", "digest", side), groups, "side", "rows", all_digests.count())
    return out.select(
        "doc_id", "keep_id", F.col("n").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
