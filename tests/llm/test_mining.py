"""Collocations, spelling variants and mixing: against brute force, on odd tables and on very long texts."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vahi.llm import collocations as C
from vahi.llm import queries
from vahi.llm import spelling as S
from vahi.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, lang string, source string"
SMALL_LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None, None, None), (2, "", "en", "b"), (3, " \t. ,\n", "en", "a"), (4, "One two. one two, ONE two", "en", "a"), (4, "One two. one two, ONE two", "en", "a"), (None, "one two", "und", "é"),
    (5, "one two", None, ""), (6, "été Été\x0bété\x1cx", "fr", "z"), (7, "word wort worde " * 400, "en", "a"), (8, "x" * 70000, "de", None), (9, "...;;a b;c\ra\tb  c", "en", "b"),
]


def odd(spark, rows=ODD):
    extra = {"key": F.lit("k"), "n": F.lit(1), "word": F.lit("w"), "size": F.lit(2), "part": F.lit("p"), "target": F.lit(0.5), "place": F.lit(1), "shard": F.lit(3), "words": F.lit("x"), "row": F.lit(1)}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


def plain_counts(rows):
    counts, totals = collections.Counter(), collections.Counter()
    for r in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r["text"] or "").translate(SMALL_LETTERS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if r["lang"] is None else r["lang"]
            totals[lang] += len(words)
            for m in range(1, 5):
                counts.update((lang, tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    return counts, totals


def plain_collocations(rows, least, top):
    counts, totals = plain_counts(rows)
    f = {k: n for k, n in counts.items() if n >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        longer = [n for (other, x), n in f.items() if other == lang and len(x) > len(w) and any(x[k : k + len(w)] == w for k in range(len(x) - len(w) + 1))]
        if any(100 * n >= 80 * a for n in longer):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize(("least", "top"), [(1, 2000), (2, 3)])
def test_collocations_of_odd_rows(spark, least, top):
    rows = [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in ODD if r[0] != 7]
    got = C.collocations(odd(spark, [r for r in ODD if r[0] != 7]), least, top).collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations(rows, least, top))
    assert C.collocations(odd(spark, [])).count() == 0


def test_collocations_across_shards_and_spans(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(["a", "bb", "c", "dé", "E"]) + rng.choice([" ", "\t", "  ", " ", ", ", ".", "\n"]) for _ in range(rng.randrange(300))), rng.choice(["en", "fr", None]), "s") for k in range(60)]
    expected = plain_collocations([{"text": t, "lang": lang} for _, t, lang, _ in rows], 4, 50)
    docs = spark.createDataFrame(rows, SCHEMA)
    for dealt in (docs.coalesce(1), docs.repartition(9)):  # one shard, and nine whose filters meet
        assert {tuple(r) for r in C.collocations(dealt, 4, 50).collect()} == expected
    # the same encoder with tiny spans and shards, here in the driver
    monkeypatch.setattr(C, "SPAN_BYTES", 64)
    monkeypatch.setattr(C, "SHARD_WORDS", 100)
    monkeypatch.setattr(C, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.record_batch([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["text", "lang"])
    shards, got = list(C._encode(iter([batch]))), collections.Counter()
    assert len(shards) > 20
    for x in C._rows_of(iter(shards)):
        place, left, lcp = C.suffix_array(x.ids, 4)
        for m in range(1, 5):
            at, n, _ = C.intervals(place, left, lcp, m)
            for key, count in zip(C._keys(x.words, x.langs, x.lang_of, x.ids, at, m).to_pylist(), n.tolist(), strict=True):
                phrase, lang = key.split("\t", 1)
                got[lang, tuple(phrase.split(" "))] += count
    assert got == plain_counts([{"text": t, "lang": lang} for _, t, lang, _ in rows])[0]


def test_shards_of_a_task_are_merged(monkeypatch):
    """A phrase is one row a task, not one for each of its shards, unless more rows are held than may be merged at once."""
    texts = [("das haus und das haus", "de"), ("das haus", "de"), ("das haus", None), ("und das haus", "de")]
    monkeypatch.setattr(C, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    shards = [next(C._encode(iter([pa.record_batch([pa.array([t]), pa.array([lang], pa.string())], names=["text", "lang"])]))) for t, lang in texts]

    def with_bits(batch):
        _, _, hashes, _ = next(C._rows_of(iter([batch]))).grams(3)
        bits = [np.packbits(np.ones(len(hashes), bool)).tobytes()] if len(hashes) else []
        return batch.append_column("bits", pa.array([bits], pa.list_(pa.binary())))

    for most, once in ((1 << 21, True), (1, False)):
        monkeypatch.setattr(C, "MERGED_ROWS", most)
        rows = [r for batch in C._phrases_of(1)(iter(map(with_bits, shards))) for r in batch.to_pylist()]
        got = collections.Counter()
        for r in rows:
            phrase, lang = r["key"].split("\t")
            assert r["length"] == len(phrase.split(" "))
            got[lang, tuple(phrase.split(" "))] += r["n"]
        assert got == plain_counts([{"text": t, "lang": lang} for t, lang in texts])[0]
        assert (len(rows) == len(got)) is once


def test_a_frequent_phrase_is_one_row_however_many_shards_have_it(spark, monkeypatch):
    """Nine shards with the same phrases: no step makes more rows than there are frequent phrases, and counts are those of brute force."""
    rng = random.Random(7)
    text = " ".join(rng.choice("abcdefgh") + rng.choice(["", "", ".", "é"]) for _ in range(4000))
    docs = spark.range(9, numPartitions=9).select(F.lit(text).alias("text"), F.when(F.col("id") % 2 == 0, "en").alias("lang"))
    made, plain = [], type(docs).mapInArrow

    def counted(df, func, schema):
        rows = spark.sparkContext.accumulator(0)
        made.append(rows)

        def counting(batches):
            for batch in func(batches):
                rows.add(batch.num_rows)
                yield batch

        return plain(df, counting, schema)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # shards stay in tasks of their own
    try:
        phrases = C.phrase_counts(docs, 5)[0].collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    counts = plain_counts([{"text": text, "lang": "en" if k % 2 == 0 else None} for k in range(9)])[0]
    expected = {(" ".join(w) + "\t" + lang, n, len(w)) for (lang, w), n in counts.items() if n >= 5}
    assert {(r.key, r.n, r.length) for r in phrases} == expected and len(phrases) == len(expected) > 4000
    assert max(x.value for x in made) <= len(expected)


def test_suffix_array_is_sorted():
    ids = np.random.default_rng(3).integers(0, 4, 3000).astype(np.int32)
    place, left, lcp = C.suffix_array(ids, 4)

    def start(p):
        out = []
        while p < len(ids) and ids[p] and len(out) < 4:
            out.append(int(ids[p]))
            p += 1
        return out

    found = [start(p) for p in place]
    assert found == sorted(found) and len(found) == int((ids > 0).sum())
    assert all(k == sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(a, b, strict=False))) for k, a, b in zip(lcp[1:].tolist(), found, found[1:], strict=False))


def test_filter_judges_equal_hashes_alike():
    """Hashes of several shards, some equal, come back as bits in each shard's own order."""
    rng = np.random.default_rng(2)
    parts, shards = 5, [rng.integers(0, 1 << 12, 400).astype(np.uint64) << np.uint64(36) for _ in range(6)]
    counts = [rng.integers(1, 4, 400).astype(np.int64) for _ in shards]

    class Shard:
        def __init__(self, k):
            self.shard = k

    total = collections.Counter()
    for h, c in zip(shards, counts, strict=True):
        for x, n in zip(h.tolist(), c.tolist(), strict=True):
            total[x] += n
    rows_of, C._rows_of = C._rows_of, lambda batches: map(Shard, range(6))
    try:
        sent = pa.Table.from_batches(list(C._sent(lambda x: (shards[x.shard], counts[x.shard]), parts)(iter([])))).sort_by("part")
    finally:
        C._rows_of = rows_of
    judged = pa.Table.from_batches(list(C._judged(9)(iter(sent.to_batches())))).sort_by([("shard", "ascending"), ("part", "ascending")]).to_pylist()
    for k, h in enumerate(shards):
        flags = C._staying(h, [r["bits"] for r in judged if r["shard"] == k], parts)
        assert flags.tolist() == [total[x] >= 9 for x in h.tolist()]


def test_top_of_groups_in_rounds(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    monkeypatch.setattr(C, "RANKED_ROWS", 50)
    got = C.top_of_groups(rows, "g", [F.desc("v")], "v", 10, 3000).collect()
    for g in (0, 1):
        expected = sorted((k * 7919 % 3001 for k in range(3000) if k % 2 == g), reverse=True)[:10]
        assert [r.v for r in sorted(got, key=lambda r: r["rank"]) if r.g == g] == expected


def plain_variants(rows, least_chars=5, least_n=3):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(SMALL_LETTERS)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_n}

    def near(a, b):
        short, long = sorted((a, b), key=len)
        if a == b or len(long) - len(short) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    found = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 2 * n[w] else None for w, x in found.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(found[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_against_all_pairs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    for w in words[:80]:  # repeated letters, shifts, ends
        k = rng.randrange(len(w) + 1)
        words += [w[:k] + rng.choice("abÉ") + w[k:], w[:k] + w[k + 1 :], w[:k] + "c" + w[k + 1 :]]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aaaaab", "ababab", "bababa", "abababa"]
    rows = [(k, " ".join(rng.choices(words, [1 / (1 + j % 50) for j in range(len(words))], k=120)) + rng.choice(["", "\n-1Ababab_", " ×÷×÷×"])) for k in range(150)]
    got = S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_variants(rows), key=str)
    assert sum(r.n_near for r in got) > 200 and any(r.root != r.form for r in got if r.form)


def test_spelling_of_odd_rows(spark):
    got = S.spelling_variants(odd(spark), 2, 1).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_variants([r[:2] for r in ODD], 2, 1), key=str)
    assert S.spelling_variants(odd(spark, [])).count() == 0


def test_spelling_of_a_long_text_and_chains(spark, monkeypatch):
    chain = ["aaaaabbbbb"[:5] + "x" * k for k in range(9)]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))
    monkeypatch.setattr(S, "PIECE_CHARS", 40)
    assert [x for piece in S._pieces(text) for x in piece.split()] == text.split()
    got = {r.word: r for r in S.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), edit_one_in=1 << 40).collect()}
    assert {r.root for r in got.values()} == {chain[-1]} and got[chain[0]].form == chain[1]


def test_one_edit_counts_in_a_bucket():
    words = ["abcde", "abcdf", "abcd", "bcde", "xabcde", "abxcde"]
    assert set(S.near_in_bucket(words[:2] + words[2:4], [True, True, False, False])) == {(1, 0), (0, 2), (0, 3), (1, 2)}
    assert S.one_edit("abcde", "abxcde") and not S.one_edit("abcde", "abcde") and not S.one_edit("abcde", "badce") and not S.one_edit("abcde", "abcdefg")


def plain_targets(sizes):
    total, weight = sum(sizes.values()), {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    capped = set()
    while True:
        left, open_ = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * left / open_ for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] >= 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(rows, got):
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    target, taken = plain_targets(size), collections.Counter()
    of = {r["doc_id"]: r for r in rows}
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r["doc_id"]) for r in rows)
    for r in got:
        source = of[r.doc_id]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", of[r.doc_id]["text"] or "")) and r.source_size == size[source]
        assert r.target == pytest.approx(target[source], rel=1e-12) and 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 2 + target[s] / 400, (s, taken[s], target[s])
    assert sum(taken.values()) == sum(size.values())


def test_mix_of_documents(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.QUERIES["op13_mixing"](spark, SMALL).collect()
    check_mix(rows, got)
    again = queries.QUERIES["op13_mixing"](spark, SMALL).repartition(3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_with_a_hot_source_and_limits(spark):
    rng = random.Random(2)
    rows = [(k, "w " * (20000 if k == 7 else rng.randrange(60)), "en", "hot" if k % 3 else rng.choice(["a", "b", "tiny" if k == 3 else "c", None, "é", "~"])) for k in range(1500)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    check_mix([dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in rows], got)


def test_mix_of_odd_rows(spark):
    got = mix_sources(odd(spark)).collect()
    assert len(got) == len(ODD) and all(0 <= r.taken <= 3 * r["size"] for r in got) and sum(r.taken for r in got) == sum(r["size"] for r in got)
    assert mix_sources(odd(spark, [])).count() == 0
    assert [tuple(r) for r in mix_sources(odd(spark, [(1, None, "en", "a"), (2, " ", None, None)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_items_of_a_window_that_occurs_often(spark):
    """A window of very many items that a document repeats gives each item once a row."""
    import hashlib

    from vahi.llm.decontamination import contamination

    window = "a b c d e f g h i j"
    items = spark.createDataFrame([(k, window) for k in range(3000)], "item_id long, text string")
    (row,) = contamination(spark.createDataFrame([(1, " ".join([window] * 2000))], "doc_id long, text string"), items).collect()
    assert (row.n_words, row.n_hit, row.n_items) == (20_000, 20_000, 3000)
    assert row.items_sha256 == hashlib.sha256(",".join(sorted(map(str, range(3000)))).encode()).hexdigest()


def test_line_batches_follow_the_rows(spark, monkeypatch):
    """One far id does not put all other rows into one batch."""
    from vahi.llm import line_dedup as L

    sizes = []
    add = L.LineRuns.add
    monkeypatch.setattr(L.LineRuns, "add", lambda self, lines: (sizes.append(lines.count()), add(self, lines))[1])
    rows = [(k, f"a line that all documents hold\nits own line number {k:06d}") for k in range(300)] + [(1 << 60, "a line that all documents hold")]
    out = {r.doc_id: r.n_dropped for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(sizes) == 3 and min(sizes) > 100 and sum(sizes) == 601
    assert out[1 << 60] == 0 and all(out[k] == 1 for k in range(300))
