"""The ten operators: SQL where it can state them, brute force and held-out accuracy elsewhere, and odd tables for all."""

import collections
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, same_rows
from vahi.llm import quality, queries, toxicity
from vahi.llm.decontamination import contamination
from vahi.llm.exact_dedup import exact_dedup
from vahi.llm.line_dedup import line_dedup
from vahi.llm.minhash import near_duplicates
from vahi.llm.sharding import shard_by_bytes
from vahi.llm.substring_dedup import substring_dedup
from vahi.llm.token_counts import token_counts

MIDDLE = "/root/testdata/sf0.01"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (5, "one  two three"), (None, "one two three"), (6, "é" * 30 + "\n" + "Ünïcode – ok"),
    (7, "word " * 5000), (8, "word " * 5000), (9, "x" * 60000), (10, "it's <|endoftext|> 'RE 12\x1c3\x85b"), (11, "\n\n"),
]
SCHEMA = "doc_id long, text string"


def odd(spark, rows=ODD):
    """Odd rows, and columns whose names clash with the operators' own."""
    extra = {"n": F.lit(1), "node": F.lit("a"), "value": F.lit(None).cast("string"), "label": F.lit(0), "keep_id": F.lit("k"), "size": F.lit(2), "part": F.lit("p")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


def run_all(spark, docs):
    benchmark = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 1), (7, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    return {
        "op1": exact_dedup(docs), "op2": substring_dedup(docs), "op3": shard_by_bytes(docs), "op4": line_dedup(docs), "op5": token_counts(docs, queries.tokenizer_path("word_bpe_49k.json")),
        "op6": contamination(docs, benchmark), "op7": queries.packed(docs), "op8": near_duplicates(docs), "op9": quality.quality(docs, quality.fit(docs, labels)), "op10": toxicity.toxicity(docs, toxicity.fit(docs, labels)),
    }


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, duck):
    same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLE_SQL[name])


def test_odd_tables(spark):
    for name, out in run_all(spark, odd(spark)).items():
        rows = out.collect()
        assert sorted({-1 if r.doc_id is None else r.doc_id for r in rows}) == [-1, *range(1, 12)], name
        assert len(rows) == len(ODD) or name == "op7", name
    for name, out in run_all(spark, odd(spark, [])).items():
        assert out.count() == 0, name


def documents(path=SMALL):
    return pq.read_table(f"{path}/documents.parquet").to_pylist()


def test_shards(spark):
    rows = queries.QUERIES["op3_sharding"](spark, SMALL).collect()
    text = {d["doc_id"]: (d["text"] or "").encode() for d in documents()}
    assert all(r["size"] == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k, members in shards.items():
        assert 0 <= k < 24 and sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / 24) < most
    ordered = sorted(rows, key=lambda r: r.doc_id)
    assert [r.shard for r in ordered] == sorted(r.shard for r in rows)


def odd_documents(spark):
    return odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"])


def test_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = odd_documents(spark)
    more = "'s'S 'tis ''re a'b’c KelvinK  x　y z w​q á ǅ İstanbul ΑΣ 1２3 \x85 \x1f"
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100, more), (101, "<|startoftext|>a<|endoftext|>b"), (102, "<|x|>a1b2_c")], SCHEMA))
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()} == want


def check_packing(rows, want, window=1024):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc, ids in want.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sequences


@pytest.mark.parametrize("table", ["odd", "small"])
def test_packing_round_trip(spark, table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    docs = odd_documents(spark) if table == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.select("doc_id", "text").collect()}
    sequences = check_packing(queries.packed(docs).collect(), want)
    assert len(sequences) <= sum(map(len, want.values())) / 1024 + 9


def test_packing_asks_for_all_terms():
    from vahi.llm import packing

    count = lambda *t: (np.array(t, np.int32), np.ones(len(t), np.int32))
    # term 39 is the seed's least worth and the only one that documents 1 to 30 share; 0 and 31 share all others
    frequency = np.ones(packing.TERMS, np.int64)
    frequency[39] = 30
    terms = [count(*range(40))] + [count(39, 100 + k) for k in range(30)] + [count(*range(39))]
    index = packing.Index(terms, packing.rarity(frequency, len(terms)), 3.0)
    index.unused[0] = False
    assert list(index.neighbours(0)) == [31, *range(1, 31)]
    index.unused[:20] = False
    assert list(index.neighbours(0)) == [31, *range(20, 31)]
    # short documents fill a window from one seed's list: 1 to 30 before the unrelated 31
    terms = [count(39, 100 + k) for k in range(31)] + [count(7)]
    index = packing.Index([terms[0], terms[31], *terms[1:31]], packing.rarity(frequency, len(terms)), 2.0)
    assert list(packing.packing_order(index, [10] * 32, 1024)) == [0, *range(2, 32), 1]


@pytest.mark.parametrize("name,label,least", [("op9_quality", "quality", 0.75), ("op10_toxicity", "toxic", 0.9)])
def test_held_out(spark, name, label, least):
    rows = queries.QUERIES[name](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where(F.col(label).isNotNull()).select("held_out", "score", F.col(label).alias("y")).collect()
    ones, zeros = [r.score for r in rows if r.held_out and r.y == 1], [r.score for r in rows if r.held_out and r.y == 0]
    assert ones and zeros
    above = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert above >= least


def test_near_duplicates_of_hot_groups(spark):
    """Long inverted lists, many copies and chains against all pairs."""
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base)) for k in range(30)] + [(100 + k, " ".join(base[:57] + [f"n{k}"])) for k in range(60)] + [(300 + k, " ".join([f"m{k}", *base[3 + k % 5 :]])) for k in range(60)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), long_list=10).collect()}
    assert got == {i: find(i) for i in sets}


@pytest.mark.parametrize("sampled", [1, 1 << 40])  # known before, or found in the task
def test_substring_dedup_of_hot_minimisers(spark, monkeypatch, sampled):
    """No task holds the runs of a hot minimiser at once; the result is that of all pairs."""
    from vahi.llm import substring_dedup as S

    passage = [f"p{k}" for k in range(12)]
    rows = [(k * 7 % 101, " ".join([f"a{k}", f"b{k % 3}", *passage[k % 2 :], f"c{k % 4}", f"d{k}"])) for k in range(90)]
    first, want = {}, {}
    for i, text in sorted(rows):
        words = text.split()
        lost = set()
        for j in range(len(words) - 7):
            if first.setdefault(tuple(words[j : j + 8]), i) < i:
                lost |= set(range(j, j + 8))
        want[i] = (len(lost), " ".join(w for j, w in enumerate(words) if j not in lost))
    monkeypatch.setattr(S, "HOT_BYTES", 1000)
    monkeypatch.setattr(S, "SAMPLED", sampled)
    got = {r.doc_id: (r.n_removed, r.text) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), 8).collect()}
    assert got == want
    minimiser = lambda rs: pa.record_batch([pa.array(x, t) for x, t in zip(([5] * len(rs), rs, *([[k] for k in range(len(rs))] for _ in range(3))), S._ROW_TYPES.types, strict=True)], schema=S._ROW_TYPES)
    held = list(S._by_minimiser(iter([minimiser([b"r%d" % k for k in range(500)])]), 100, frozenset()))
    assert max(len(x) for wide, x in held) < 500 and all(wide for wide, _ in held) and sum(len(x) for _, x in held) == 500


def test_exact_dedup_digest(spark):
    rows = exact_dedup(odd(spark)).where("doc_id = 5").collect()
    assert rows[0].text_sha256 == hashlib.sha256(b"one two three").hexdigest() and rows[0].keep_id == 4


def test_fuse_filter():
    from vahi.llm import fuse_filter

    rnd = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 20_000):
        keys = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        seed, packed = fuse_filter.build(keys)
        assert fuse_filter.might_hold(keys, seed, packed).all()
        others = rnd.integers(0, 1 << 63, 200_000, dtype=np.uint64)
        assert fuse_filter.might_hold(others, seed, packed).mean() < 1e-3
    assert len(packed) < 2 * 1.4 * n  # nearer to 1.13 fingerprints a key for more keys


def groups_of(rows):
    by = collections.defaultdict(list)
    for i, text in rows:
        by[" ".join(__import__("re").split("[ \t-\r]+", text or ""))].append(i)
    return by


def test_exact_dedup_depends_on_its_filters(spark, monkeypatch):
    """With uneven ids the result is that of plain grouping; a screen that passes nothing, or bytes that never agree, leave a batch's copies apart."""
    from vahi.llm import exact_dedup as E

    rows = [(1, "a b"), (10**12, "x"), *((10**12 + k, f"t{k % 40}  u") for k in range(1, 200)), (10**12 + 500, "a  b"), (None, "x"), (None, "lonely")]
    want = {i: (min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups_of(rows).values() for i in ids if i is not None}
    docs = spark.createDataFrame(rows, SCHEMA)
    run = lambda: {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs).collect() if r.doc_id is not None}
    assert run() == want
    screen, held = E.Snapshot.screen, E.Snapshot.held
    monkeypatch.setattr(E.Snapshot, "screen", lambda self, groups: screen(self, groups).limit(0))
    assert run()[10**12 + 500] == (10**12 + 500, 1)
    monkeypatch.setattr(E.Snapshot, "screen", screen)
    monkeypatch.setattr(E.Snapshot, "held", lambda self, d, p: held(self, d.withColumn("text", F.concat("text", F.lit("!"))), p))
    assert run()[10**12 + 500] == (10**12 + 500, 1)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_substring_dedup", "op4_line_dedup", "op6_decontamination", "op8_minhash"])
def test_values_on_odd_documents(spark, tmp_path, name):
    """Odd rows with ids, run through the query and through its SQL."""
    import duckdb

    line = "A line that is long enough to count"
    more = [(20, f"{line}\n b"), (21, f" {line.upper()} \nc"), (22, f"{line}\n{line}"), (23, " ".join(f"w{k}" for k in range(70))), (24, "x " + " ".join(f"w{k}" for k in range(70)) + " one two three y")]
    docs = odd_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(more, SCHEMA))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, " ".join(f"W{k}" for k in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same_rows(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLE_SQL[name])


def test_decontamination_in_blocks(spark):
    docs, benchmark = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, contamination(docs, benchmark).collect()))
    assert sorted(map(tuple, contamination(docs, benchmark, block_bytes=100_000).collect())) == whole
    from vahi.llm.decontamination import without_contaminated

    clean = {r.doc_id for r in without_contaminated(docs, benchmark, block_bytes=100_000).collect()}
    assert clean == {r[0] for r in whole if not r[-1]}


def test_long_texts_in_pieces(monkeypatch):
    from vahi.llm import common

    text = ("alpha beta  gamma\n" * 50 + "z" * 700 + " " + "y" * 90 + " end ").encode()
    data, bounds = np.frombuffer(text + b"b c", np.uint8), np.array([0, len(text), len(text) + 3])
    whole = common.word_hashes(data, bounds)
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    pieces = common.word_hashes(data, bounds)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all() and len(whole[0]) == 155


def test_sketches_lose_few_links():
    from math import comb

    from vahi.llm import minhash

    for n in (1, 10, 64):
        c = minhash.least_shared(n, 85)
        tail = lambda m: sum(comb(n, k) * 0.85**k * 0.15 ** (n - k) for k in range(m))  # noqa: E731, B023
        assert tail(c) <= minhash.MISSED < tail(c + 1)


def test_components(spark):
    from vahi.llm.components import components

    chain, star = [(k, k + 1) for k in range(100, 160)], [(1000, k) for k in range(1001, 1200)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1000 for k in range(1000, 1200)}


def test_token_query_is_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = {d["doc_id"]: (len((d["text"] or "").encode()), len(library.encode(d["text"] or "", add_special_tokens=False))) for d in documents()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.QUERIES["op5_token_counts"](spark, SMALL).collect()}
    assert got == want


def test_trees_are_those_of_a_plain_walk():
    rnd = np.random.default_rng(1)
    x = rnd.random((400, len(quality.STATISTICS)))
    y = (x[:, 0] + x[:, 3] > 1).astype(float)
    model = quality.boost(x, y, np.ones(len(y)))
    for row in x[:50]:
        total = model.base
        for statistic, threshold, leaf in zip(model.statistic, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(statistic):
                node = 2 * node + (2 if row[statistic[node]] > threshold[node] else 1)
            total += leaf[node - len(statistic)]
        assert abs(total - model.margins(row[None])[0]) < 1e-9
    assert (((model.margins(x) > 0) == y).mean()) > 0.95


def test_counts_of_grams_are_those_of_a_plain_recount(spark):
    rows = [(1, "You FOOL,  you", 1), (2, "kind words é", 0), (3, None, 0), (4, "fool fool", 1), (5, "x", 0)]
    got = toxicity._counts(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    want = np.zeros((2, toxicity.SLOTS))
    for _, text, y in rows:
        clean = f" {' '.join(text.lower().split())} " if text else " "
        slots = set()
        for n in toxicity.LENGTHS:
            for at in range(len(clean) - n + 1):
                total = sum(ord(c) * int(m) for c, m in zip(clean[at : at + n], toxicity._BY_PLACE, strict=False)) % 2**32
                h = ((total ^ (total >> 15)) * int(toxicity._SPREAD) + n) % 2**32
                h = ((h ^ (h >> 13)) * int(toxicity._BY_PLACE[0])) % 2**32
                slots.add(h >> (32 - toxicity.SLOT_BITS))
        for slot in slots:
            want[y, slot] += 1
    assert (got == want).all()


def test_packing_puts_likes_together(spark):
    """Documents that follow each other in a sequence share more words than in a random order."""
    text = {d["doc_id"]: set((d["text"] or "").split()) for d in documents(MIDDLE)}
    rows = queries.QUERIES["op7_packing"](spark, MIDDLE).where("start = 0").select("doc_id", "sequence_id", "offset").collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    alike = lambda ids: float(np.mean([len(text[a] & text[b]) / max(1, len(text[a] | text[b])) for a, b in zip(ids, ids[1:])]))  # noqa: E731, B905
    by_chance = alike(np.random.default_rng(0).permutation(order).tolist())
    assert alike(order) > 1.5 * by_chance


def stage_rows(spark, name, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"lang": F.lit("en"), "_key": F.lit(1), "kept": F.lit("k"), "digest": F.lit("d"), "row_key": F.lit("r")})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL)
    assert out.columns == docs.columns
    return collections.Counter((r.doc_id, r.text) for r in out.collect())


def test_stages_drop_rows_and_not_ids(spark):
    words = " ".join(f"w{k}" for k in range(60))
    item = next(b["text"] for b in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist() if len((b["text"] or "").split()) > 12)
    rows = [(3, "same text"), (7, "same text"), (7, "a unique text"), (7, "a unique  text"), (None, "same text"), (None, "only here"), (9, None), (9, ""), (8, None)]
    assert stage_rows(spark, "exact_dedup", rows) in [collections.Counter([(3, "same text"), (7, t), (None, "only here"), (8, None)]) for t in ("a unique text", "a unique  text")]
    near = [(3, words), (7, words + " more"), (7, "a unique text of some words"), (None, words + " other"), (5, None), (5, "")]
    assert stage_rows(spark, "near_dedup", near) == collections.Counter([(3, words), (7, "a unique text of some words"), (None, words + " other"), (5, None), (5, "")])
    dirty = [(3, f"so {item} it is"), (3, "clean"), (None, item), (None, "clean"), (4, None), (5, "")]
    assert stage_rows(spark, "decontamination", dirty) == collections.Counter([(3, "clean"), (None, "clean"), (4, None), (5, "")])
    for name in ("toxicity", "exact_dedup", "near_dedup", "decontamination"):
        assert not stage_rows(spark, name, [])
    assert set(stage_rows(spark, "toxicity", dirty)) <= set(dirty)


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = corpus_pipeline.documents(spark, SMALL)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, SMALL), name)
        assert docs.columns == before.columns and docs.count() <= before.count()
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    check_packing(corpus_pipeline.run(spark, SMALL).collect(), want)


def test_components_after_more_links(spark):
    from vahi.llm.components import components, with_links

    some = lambda *pairs: spark.createDataFrame([*pairs], "a long, b long")
    label = components(some((5, 9), (9, 12), (3, 4), (20, 21)))
    got = lambda x: {r.node: r.component for r in x.collect()}
    before = {5: 5, 9: 5, 12: 5, 3: 3, 4: 3, 20: 20, 21: 20}
    assert got(with_links(label, some())) == got(label) == before
    assert got(with_links(label, some((12, 4), (21, 1), (30, 31)))) == {5: 3, 9: 3, 12: 3, 3: 3, 4: 3, 20: 1, 21: 1, 1: 1, 30: 30, 31: 30}
