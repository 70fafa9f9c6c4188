"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vahi.llm.common import WHITE, chunks, clean_text, join_by, new_path, stored, tasks, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text):
    """The lines of a text, parted at newlines; an empty text has one empty line."""
    return F.split(text, "\n", -1)


def key_of(line):
    """A line's key: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def key_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_key, line_no, key) of the lines with long enough keys; the key is the MD5 digest, 16 bytes."""
    each = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(lines_of(clean_text())).alias("line_no", "line"))
    each = each.withColumn("line", key_of("line")).where(F.char_length("line") >= least_chars)
    return each.select("doc_id", "text_key", "line_no", F.unhex(F.md5("line")).alias("key"))


@contextmanager
def _in_order(spark: SparkSession) -> Iterator[None]:
    """While plans are made here, a scan of a sorted bucketed table counts as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LineRuns:
    """Immutable runs of (key, owner, n_docs), in levels as a log-structured tree keeps them.

    A run is a table of buckets by key, each one file sorted by key, so that runs merge with each other and with a batch without being shuffled or sorted again.
    Batches come in descending order of doc_id. A batch is summed to one row a key; keys that a merge join finds in no run are first seen, and the batch's
    largest doc_id becomes their owner; known keys add to the count only. Both make the batch's own run at level 0. When a level holds `fanout` runs they are
    merged into one run of the next level. A run is in the shared folder, so losing executors loses nothing. Hot keys are summed before the shuffle.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 4):
        self.spark, self.buckets, self.fanout, self.levels, self.made = spark, buckets, fanout, [[]], []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        with _in_order(self.spark):
            rows.repartition(self.buckets, "key").sortWithinPartitions("key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", new_path(self.spark, "line-run")).saveAsTable(name)
        self.made.append(name)
        return self.spark.table(name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run from several: a merge join of sorted buckets at a time."""

        def both(x: DataFrame, y: DataFrame) -> DataFrame:
            y = y.select("key", F.col("owner").alias("_owner"), F.col("n_docs").alias("_n"))
            out = x.hint("merge").join(y, "key", "full")
            return out.select("key", F.greatest("owner", "_owner").alias("owner"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"))

        return reduce(both, runs)

    def add(self, lines: DataFrame) -> None:
        """lines: doc_id and key of a batch whose doc_ids are below those of the batches before."""
        per_doc = lines.select("doc_id", "key").distinct()
        batch = per_doc.groupBy("key").agg(F.max("doc_id").alias("owner"), F.count("*").alias("n_docs"))
        if known := self.runs():
            seen = F.lit(False)
            for k, run in enumerate(known):
                batch = batch.hint("merge").join(run.select("key", F.lit(True).alias(f"_in{k}")), "key", "left")
                seen |= F.coalesce(f"_in{k}", F.lit(False))
            batch = batch.select("key", F.when(~seen, F.col("owner")).alias("owner"), "n_docs")
        self.levels[0].append(self._write(batch))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merged(self.levels[k])))
                self.levels[k] = []

    def common(self, least_docs: int) -> DataFrame:
        """(key, owner, n_docs) of the keys found in at least so many documents, stored; the runs' tables go with it, for it is the last that reads them."""
        with _in_order(self.spark):
            out = stored(self._merged(self.runs()).where(F.col("n_docs") >= least_docs), "common-lines")
        for name in self.made:
            self.spark.sql(f"DROP TABLE {name}")
        return out


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their lost lines; a text of any number of lines is walked once."""
    for part in chunks(batches, "text"):
        n_lines, n_dropped, kept = [], [], []
        for text, lost in zip(part.column("text").to_pylist(), part.column("lost").to_pylist(), strict=True):
            n_lines.append((text or "").count("\n") + 1)
            n_dropped.append(len(lost or ()))
            if lost:
                gone = set(lost)
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
            kept.append(text)
        yield pa.record_batch([part.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


#: Lines of a bucket of a run.
BUCKET_LINES = 4_000_000


def line_dedup(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Drop lines that many documents share, except in the largest doc_id that holds them.

    Returns one row per input row: doc_id, n_lines, n_dropped, text (what is kept, joined by newlines; null if the text was null and so stays one empty line).
    Null or empty text: one empty line, kept. Rows with a null doc_id neither count nor lose lines. Repeated rows of one doc_id count once and
    are treated alike. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = stored(key_lines(docs.where("doc_id is not null"), least_chars), "lines")
    low, high, total = lines.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if low is not None:
        runs = LineRuns(spark, max(tasks(spark), total // BUCKET_LINES + 1), fanout)
        shares = [k / batches for k in range(1, batches)]
        cuts = lines.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 1000)).first()[0] if shares else []
        edges = [low, *sorted({c for c in cuts if low < c <= high}), None]  # batches of about as many lines; equal ids stay together
        for first, past in reversed(list(zip(edges, edges[1:], strict=False))):
            runs.add(lines.where(F.col("doc_id") >= first) if past is None else lines.where((F.col("doc_id") >= first) & (F.col("doc_id") < past)))
        lost = join_by(lines, runs.common(least_docs), "key", "n_docs", total).where("doc_id <> owner").select("doc_id", "text_key", "line_no")
    else:
        lost = lines.select("doc_id", "text_key", "line_no")
    lost = lost.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("lost"))
    out = docs.withColumn("text_key", text_key()).join(lost, ["doc_id", "text_key"], "left").select("doc_id", "text", "lost")
    return out.mapInArrow(_without_lines, "doc_id long, n_lines long, n_dropped long, text string")
