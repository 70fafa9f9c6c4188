"""Joins of texts by similarity, containment or common words that meet only where they can match: no pair is looked at that shares nothing rare."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vahi.functions import text as T
from vahi.storage import forget, stored


#: Texts of a block: what one task compares at a time is two blocks.
BLOCK = 1 << 15
#: Blocks that are broadcast at most.
FEW_BLOCKS = 20_000
#: Texts of a block that are counted side by side, neighbours in the order of texts.
COLUMNS = 1024
#: Words of 64 columns that one operation on bits covers.
WORDS = 4096


def _texts(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The distinct texts t of a column, numbered; stored, so that the numbers stay."""
    return stored(rows.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("t")).distinct().withColumn("id", F.monotonically_increasing_id()), "names")


def _with_bigrams(rows: DataFrame) -> DataFrame:
    """rows with `grams`, the bigrams of the text t as whole numbers: two code points, and which occurrence of them it is, so that a multiset becomes a set."""
    code = lambda k: F.ascii(F.substring(F.col("t"), k, F.lit(1))).cast("long")
    ordered = F.sort_array(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda k: code(k) * (1 << 42) + code(k + 1) * (1 << 21)))
    rows = rows.withColumn("_ordered", ordered)  # a column of its own, or the lambda would make it anew for each bigram
    return rows.withColumn("grams", F.transform("_ordered", lambda g, k: g + k - F.array_position("_ordered", g) + 1)).drop("_ordered")


def _least_shared(n: Column, m: Column, least: float) -> Column:
    """How many bigrams texts with n and m must share to reach the score."""
    return F.ceil(F.lit(least / 2) * (n + m) - F.lit(1e-9))


def dice_candidates(x: DataFrame, y: DataFrame, by: list[str], least: float) -> tuple[DataFrame, DataFrame]:
    """The pairs (by, id_a, id_b) of numbered texts that may reach the score, each once, and all texts' bigrams (side, id, grams).

    Texts of n and m bigrams must share s = ceil(least / 2 (n + m)) of them. In the order from rare to common, they then share one among the first n - s + 1 of
    the one and the first m - s + 1 of the other: bigrams meet only there (prefix filter, for each pair's own lengths). A bigram that both share as i-th and j-th
    leaves at most min(i, j) + min(n - i, m - j) shared ones (positional filter). What meets are numbers; the bigrams themselves stay behind.
    """
    both = x.select(*by, "id", F.lit("a").alias("side"), "t").unionByName(y.select(*by, "id", F.lit("b").alias("side"), "t")).where(F.length("t") > 1)
    each = _with_bigrams(both).select(*by, "side", "id", F.explode_outer("grams").alias("g"))  # none is empty, and explode would ask twice
    each = stored(each, "bigrams")
    times = each.groupBy(*by, "g").agg(F.count("*").alias("df"))
    ranked = each.join(times, [*by, "g"]).groupBy(*by, "side", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "g"))), lambda z: z.g).alias("grams"))
    ranked = stored(ranked.withColumn("n", F.size("grams")), "bigrams")
    forget(each)
    longest = (F.col("n") - F.ceil(F.col("n") * F.lit(least / (2 - least)) - F.lit(1e-9)) + 1).cast("int")  # for the shortest partner there can be
    prefix = ranked.select(*by, "side", "id", "n", F.posexplode(F.slice("grams", F.lit(1), longest)).alias("i", "g")).withColumn("i", F.col("i") + 1)
    side = lambda s: prefix.where(F.col("side") == s).select(*by, "g", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "i")])
    n, m, i, j = (F.col(c) for c in ("n_a", "n_b", "i_a", "i_b"))
    need = _least_shared(n, m, least)
    met = side("a").join(side("b"), [*by, "g"]).where((need <= F.least(n, m)) & (i <= n - need + 1) & (j <= m - need + 1) & (F.least(i, j) + F.least(n - i, m - j) >= need))
    return met.select(*by, "id_a", "id_b").distinct(), ranked


def _in_blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose text t has bigrams, with `_block`: at most BLOCK neighbours in the order of texts within equal `by` columns."""
    rows = rows.where(F.length("t") > 1)
    dealt = rows.repartitionByRange(rows.count() // (4 * BLOCK) + 1, *by, "t").sortWithinPartitions(*by, "t").withColumn("_at", F.monotonically_increasing_id())
    block = F.shiftright("_at", 33) * (1 << 33) + (F.col("_at") % (1 << 33) / BLOCK).cast("long")  # the bits above 33 are the partition
    return stored(dealt.withColumn("_block", block).drop("_at"), "blocks")


def _sent(rows: DataFrame, others: DataFrame, by: list[str], own: str, other: str) -> DataFrame:
    """rows once for each block of the others."""
    each = stored(others.select(*by, F.col("_block").alias(other)).distinct(), "block-names")
    return rows.withColumnRenamed("_block", own).join(F.broadcast(each) if each.count() <= FEW_BLOCKS else each, by)


def _numbered(texts: list[str]):
    """The bigrams of texts as (text's number, bigram, which occurrence of it in the text, from 0)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = row[1:] == row[:-1]
    r, g = row[:-1][inside], (codes[:-1] * (1 << 21) + codes[1:])[inside]
    order = np.lexsort((g, r))
    r, g, at = r[order], g[order], np.arange(len(r))
    first = np.maximum.accumulate(np.where(np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])], at, 0))
    return r, g, at - first


def _sums(planes: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The sums of numbers that lie in columns of bits: planes[k] holds bits that count 2 ** k, all of one shape; the last place overflows into nothing."""
    out = []
    for k, at in enumerate(planes):
        more = planes[k + 1] if k + 1 < len(planes) else []
        while len(at) > 2:
            x, y, z = at.pop(), at.pop(), at.pop()
            either = x ^ y
            more.append((x & y) | (either & z))
            at.append(either ^ z)
        if len(at) == 2:
            x, y = at
            more.append(x & y)
            at = [x ^ y]
        out.append(at[0])
    return out


class _Side:
    """The bigrams of a block's texts that the other block has too: dims, those of text i from starts[i] on; n is how many bigrams each has at all."""

    def __init__(self, texts: list[str], rows: np.ndarray, dims: np.ndarray, both: np.ndarray):
        at = np.minimum(np.searchsorted(both, dims), max(len(both) - 1, 0))
        held = both[at] == dims if len(both) else np.zeros(len(dims), bool)
        self.n = np.array([len(t) - 1 for t in texts], np.int64)
        self.rows, self.dims = rows[held], at[held]
        self.starts = np.searchsorted(self.rows, np.arange(len(texts) + 1))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of each dim over the dims of each text."""
        total = np.r_[0, np.cumsum(values[self.dims])]
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The dims of these texts, and beside each the text's place in the list."""
        lengths = self.starts[texts + 1] - self.starts[texts]
        ends = np.cumsum(lengths)
        return np.repeat(np.arange(len(texts)), lengths), self.dims[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[texts] - ends + lengths, lengths)]


def _sides(a: list[str], b: list[str]) -> tuple[_Side, _Side, int]:
    (ra, ga, ka), (rb, gb, kb) = _numbered(a), _numbered(b)
    times = max(ka.max(), kb.max()) + 1
    _, ids = np.unique(np.r_[ga, gb], return_inverse=True)
    ia, ib = ids[: len(ga)] * times + ka, ids[len(ga) :] * times + kb
    both = np.intersect1d(ia, ib)
    return _Side(a, ra, ia, both), _Side(b, rb, ib, both), len(both)


def _reaching(a: list[str], b: list[str], same: np.ndarray, least: float, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places i, j of unequal texts that reach the score, and the score; with `best`, for each i only the best one, of equally good ones that of the smallest j.

    Shared bigrams are counted for 64 texts of b at a time: each bigram is a row of bits, one for each text of some neighbours, and a text of a adds up the rows of its bigrams. Bigrams
    that all of the neighbours have are not added but known. A text of a meets only neighbours that could reach the score if one of them had all their bigrams. same[i] is the j of the
    equal text, or -1.
    """
    x, y, dims = _sides(a, b)
    order = np.array(sorted(range(len(b)), key=b.__getitem__))
    top, top_j = np.full(len(a), least), np.full(len(a), -1)
    found = []
    for begin in range(0, len(b), COLUMNS):
        cols = order[begin : begin + COLUMNS]
        cols = cols[np.argsort(y.n[cols], kind="stable")]
        col, dim = y.of(cols)
        words = -(-len(cols) // 64)
        times = np.bincount(dim, minlength=dims)
        kind = np.where(times == len(cols), 1 << 32, times > 0)  # all have it, some have it, none
        counts = x.per_text(kind)
        known, some = counts >> 32, counts & 0xFFFFFFFF
        common = np.count_nonzero(times == len(cols))
        m = np.clip(some + common, y.n[cols[0]], y.n[cols[-1]])  # the length that would score best
        queries = np.flatnonzero(2.0 * (known + np.minimum(some, m - common)) >= top * (x.n + m) - 1e-9)
        if not len(queries):
            continue
        held = np.flatnonzero(kind == 1)
        local = np.full(dims, -1)
        local[held] = np.arange(len(held))
        bits = np.zeros((len(held) + 1) * words, np.uint64)  # the last row is empty
        own = local[dim] >= 0
        at = local[dim[own]] * words + col[own] // 64
        by_word = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[by_word], prepend=-1))
        if len(first):
            bits[at[by_word][first]] = np.bitwise_or.reduceat((np.uint64(1) << (col[own] % 64).astype(np.uint64))[by_word], first)
        bits = bits.reshape(-1, words)
        shortest = y.n[cols[::64]]  # of each word
        queries = queries[np.argsort(some[queries], kind="stable")]
        step = max(1, WORDS // words * 64 // max(64, int(some[queries[-1]])))  # long texts add up many rows
        for start in range(0, len(queries), step):
            q = queries[start : start + step]
            most = int(some[q[-1]])
            places = most.bit_length()  # 2 ** places > most
            row, dim_q = x.of(q)
            mine = local[dim_q] >= 0
            row, dim_q = row[mine], local[dim_q[mine]]
            ids = np.full((most, len(q)), len(held))
            ids[np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row], row] = dim_q
            need = np.ceil(top[q, None] / 2 * (x.n[q, None] + shortest) - 1e-9) - known[q, None]
            offset = ((1 << places) - np.clip(need, 0, most + 1)).astype(np.min_scalar_type(1 << places))  # with it, the sum overflows where there are enough
            planes = [[np.negative((offset >> k & 1).astype(np.uint64))] for k in range(places + 1)]
            planes[0].extend(bits.take(r, axis=0) for r in ids)
            sums = _sums(planes)
            enough = sums[-1].ravel()
            word = np.flatnonzero(enough)
            if not len(word):
                continue
            k, bit = np.nonzero(np.unpackbits(enough[word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            word = word[k]
            inside = word % words * 64 + bit < len(cols)
            word, bit = word[inside], bit[inside]
            value = sum((sums[p].ravel()[word] >> bit.astype(np.uint64) & np.uint64(1)).astype(np.int64) << p for p in range(places + 1))
            i, j = q[word // words], cols[word % words * 64 + bit]
            score = 2.0 * (value - offset.ravel()[word].astype(np.int64) + known[i]) / (x.n[i] + y.n[j])
            reach = (score >= top[i]) & (same[i] != j)
            i, j, score = i[reach], j[reach], score[reach]
            if not best:
                found.append((i, j, score))
            elif len(i):
                group = np.flatnonzero(np.diff(i, prepend=-1))
                sizes = np.diff(np.r_[group, len(i)])
                high = np.maximum.reduceat(score, group)
                low = np.minimum.reduceat(np.where(score == np.repeat(high, sizes), j, len(b)), group)
                i = i[group]
                better = (high > top[i]) | (top_j[i] < 0) | (low < top_j[i])
                top[i[better]], top_j[i[better]] = high[better], low[better]
    if best:
        i = np.flatnonzero(top_j >= 0)
        return i, top_j[i], top[i]
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _meet(by: list[str], least: float, rank: list[str], best: bool):
    """Two blocks to their unequal texts that reach the score; with `best`, each left text's best only, the first in the order of rank among equals."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([(c, "ascending") for c in [*rank, "t"]]) if best else right
        i = j = np.zeros(0, np.int64)
        score = np.zeros(0)
        if left.num_rows and right.num_rows:
            a, b = left["t"].to_pylist(), right["t"].to_pylist()
            place = {t: k for k, t in enumerate(b)}
            i, j, score = _reaching(a, b, np.array([place.get(t, -1) for t in a]), least, best)
        mine, theirs = left.select([*by, "t"]).take(pa.array(i)), right.select(["t", *rank]).take(pa.array(j))
        return pa.table([*[mine[c] for c in by], mine["t"], theirs["t"], pa.array(score), *[theirs[c] for c in rank]], names=[*by, "_a", "_b", "score", *rank])

    return meet


def _scored(x: DataFrame, y: DataFrame, by: list[str], least: float, rank: list[str], best: bool) -> DataFrame:
    """(by, _a, _b, score, rank) of the unequal texts t of both sides that reach the score: blocks of neighbours in the order of texts meet, two a time.

    Pairs are neither shuffled nor stored. What is shuffled are texts, once for each block of the other side within equal `by` columns.
    """
    x, y = _in_blocks(x, by), _in_blocks(y, by)
    keys = [*by, "_x", "_y"]
    a, b = _sent(x, y, by, "_x", "_y"), _sent(y, x, by, "_y", "_x")
    fields = {f.name: f for f in [*x.schema.fields, *y.schema.fields]}
    text = lambda c: StructField(c, StringType())
    schema = StructType([*[fields[c] for c in by], text("_a"), text("_b"), StructField("score", DoubleType()), *[fields[c] for c in rank]])
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_meet(by, least, rank, best), schema)


def _equal(x: DataFrame, y: DataFrame, by: list[str], rank: list[str]) -> DataFrame:
    """(by, _a, _b, score, rank) of equal texts, which score 1 even without bigrams."""
    return x.select(*by, "t").join(y.select(*by, "t", *rank), [*by, "t"]).where(F.col("t") != "").select(*by, F.col("t").alias("_a"), F.col("t").alias("_b"), F.lit(1.0).alias("score"), *rank)


def dice_join(left: DataFrame, right: DataFrame, a: str, b: str, by: list[str], least: float) -> DataFrame:
    """Distinct (by, a, b, score) of the texts of both sides whose Dice similarity is at least `least`, within equal `by` columns.

    Blocks of texts meet, see _scored; equal texts join directly. Null texts match nothing; texts of one character match only themselves.
    """
    x, y = _texts(left, a, by), _texts(right, b, by)
    return _scored(x, y, by, least, [], False).unionByName(_equal(x, y, by, [])).withColumnsRenamed({"_a": a, "_b": b})


def nearest(left: DataFrame, right: DataFrame, a: str, b: str, by: list[str], least: float, rank: list[str], equal: bool = True) -> DataFrame:
    """(by, a, score, rank) of the best text of the right side for each text of the left one that has any of at least this similarity: by score, then by the columns of rank, ascending.

    The right side has one row a text. Each task keeps a text's best in a block only, so what is shuffled grows with the texts and not with the pairs. Without `equal`, equal texts are passed over.
    """
    x, y = _texts(left, a, by), stored(right.where(F.col(b).isNotNull()).select(*by, F.col(b).alias("t"), *rank), "names")
    met = _scored(x, y, by, least, rank, True)
    met = met.unionByName(_equal(x, y, by, rank)) if equal else met
    first = F.min(F.struct((-F.col("score")).alias("_s"), *rank)).alias("_r")
    return met.groupBy(*by, F.col("_a").alias(a)).agg(first).select(*by, a, (-F.col("_r._s")).alias("score"), *[F.col(f"_r.{c}").alias(c) for c in rank])


def subset_join(left: DataFrame, right: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """The distinct (by, a, b) of unequal texts where the words of the one with fewer are all among the other's and both begin with the same word.

    The one with fewer words meets the other at its rarest word, by counts over both sides; then first words and all words are compared.
    """
    both = _texts(left, a, by).withColumn("side", F.lit("a")).unionByName(_texts(right, b, by).withColumn("side", F.lit("b"))).withColumn("w", T.tokens(F.col("t"))).where(F.size("w") > 0)
    posted = stored(both.select(*by, "side", "t", F.size("w").alias("n"), F.element_at("w", 1).alias("first"), F.explode(F.array_distinct("w")).alias("word")), "words")
    times = posted.groupBy(*by, "word").agg(F.count("*").alias("df"))
    rarest = posted.join(times, [*by, "word"]).groupBy(*by, "side", "t", "n", "first").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    of = lambda rows, s: rows.where(F.col("side") == s).select(*by, "word", "first", F.col("t").alias(f"_{s}"), F.col("n").alias(f"n_{s}"))
    fewer = of(rarest, "a").join(of(posted, "b"), [*by, "word", "first"]).where("n_a <= n_b")
    more = of(posted, "a").join(of(rarest, "b"), [*by, "word", "first"]).where("n_a > n_b")
    met = fewer.unionByName(more).where((F.col("_a") != F.col("_b")) & T.token_subset(F.col("_a"), F.col("_b")))
    return met.select(*by, F.col("_a").alias(a), F.col("_b").alias(b))


#: Characters of the grams at which a pattern meets texts.
GRAM = 3


def contains_join(hay: DataFrame, needles: DataFrame, text: str, pattern: str, by: list[str]) -> DataFrame:
    """The distinct (by, text, pattern) where the text contains the pattern, within equal `by` columns; empty patterns match nothing.

    A pattern meets texts only at its rarest gram of three characters, by counts over all places of the texts, and is compared there at its place; a pattern of fewer
    characters is its own gram. A pattern with a gram that no text has meets nothing.
    """
    texts = stored(hay.where(F.col(text) != "").select(*by, F.col(text).alias("_t")).distinct(), "texts")
    patterns = stored(needles.where(F.col(pattern) != "").select(*by, F.col(pattern).alias("_p")).distinct().withColumn("q", F.least(F.length("_p"), F.lit(GRAM))), "patterns")
    sizes = [r.q for r in patterns.select("q").distinct().collect()]  # at most GRAM
    at = texts.select(*by, "_t", F.explode(F.sequence(F.lit(1), F.length("_t"))).alias("i"))
    grams = at.select(*by, "_t", "i", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("q")).withColumn("g", F.substring(F.col("_t"), F.col("i"), F.col("q")))
    grams = grams.where(F.length("g") == F.col("q")).drop("q")  # what begins too late is shorter
    times = grams.groupBy(*by, "g").agg(F.count("*").alias("df"))
    own = patterns.select(*by, "_p", F.explode(F.sequence(F.lit(0), F.length("_p") - F.col("q"))).alias("k"), "q").withColumn("g", F.substring(F.col("_p"), F.col("k") + 1, F.col("q")))
    rarest = own.join(times, [*by, "g"], "left").groupBy(*by, "_p").agg(F.min_by(F.struct("g", "k"), F.struct(F.coalesce("df", F.lit(0)), "k")).alias("at")).select(*by, "_p", "at.g", "at.k")
    met = grams.join(rarest, [*by, "g"]).where((F.col("i") > F.col("k")) & (F.substring(F.col("_t"), F.col("i") - F.col("k"), F.length("_p")) == F.col("_p")))
    return met.select(*by, F.col("_t").alias(text), F.col("_p").alias(pattern)).distinct()
