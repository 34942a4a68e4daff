"""Small tables with known or brute-force results, and the defined edge cases, for every operator."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memberlens.llm import (
    boosting, decontamination, fingerprints, licenses, ngram_join, quality, queries, sentencepieces, sharding,
    token_counts, token_files, toxicity,
)
from memberlens.llm.common import only_ids, without_ids
from memberlens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, id string, n string"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _words(seed: int, n: int, vocabulary: int = 60) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def _texts() -> list[tuple[int | None, str | None]]:
    base = _words(1, 80)
    rows = [(10 + k, " ".join([*base[: 3 * k], "changed", *base[3 * k + 1 :]])) for k in range(6)]
    rows += [(1, " ".join(base)), (2, " ".join(base).upper()), (3, "  \t"), (4, ""), (5, None), (6, "a b"), (7, "A  b"), (8, "b a")]
    rows += [(30 + k, " ".join(_words(50 + k, 40))) for k in range(5)]
    rows += [(40, "x " * 300), (41, "x " * 20), (1, " ".join(base)), (None, "a b"), (None, None)]
    rows += [(50, " ".join(_words(9, 12_000, 5_000))), (51, " ".join(_words(9, 12_000, 5_000)[:-40]))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in _texts()], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _shingles(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _brute_components(rows) -> dict:
    sets = {i: _shingles(t) for i, t in rows if i is not None}
    lowest = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 80 * len(sets[a] | sets[b]) and lowest[a] > lowest[b]:
                    lowest[a], moved = lowest[b], True
    return {i: (len(sets[i]), lowest[i]) for i in sets}


@pytest.mark.parametrize("hot", [ngram_join.HOT_TEXTS, 1])
def test_similarity_join_is_brute_force(docs, hot):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_join(docs, hot_texts=hot).collect() if r.doc_id is not None}
    assert got == _brute_components(_texts())


@pytest.mark.parametrize("block_texts", [ngram_join.BLOCK_TEXTS, 2])
def test_similarity_join_counts_every_link(spark, monkeypatch, block_texts):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block_texts)
    long = _words(3, 120, 5_000)
    # copies with a change each, a chain that drops words step by step, and an exact copy
    texts = {k: " ".join(w if n != 10 * k + 5 else "new" for n, w in enumerate(long)) for k in range(12)}
    chain = _words(5, 400, 5_000)
    texts |= {20 + k: " ".join(chain[40 * k : 40 * k + 260]) for k in range(4)} | {30: texts[3].upper(), 31: "alone", 32: None}
    texts |= {40 + k: " ".join(chain[20 * k : 20 * k + 200]) for k in range(4)}
    sets = {i: _shingles(t) for i, t in texts.items()}
    expected = {
        i: sum(b != 30 and own != sets[b] and len(own & sets[b]) * 100 >= 80 * len(own | sets[b]) for b in sets if own and sets[b])
        for i, own in sets.items()
    }
    assert expected[30] == expected[3] > 1 and expected[31] == expected[32] == 0 and expected[41] == 2 and expected[40] == 1
    frame = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.n_links for r in ngram_join.similarity_join(frame).collect()} == expected


def test_links_of_ids_with_several_texts(spark):
    long, other = _words(3, 120, 5_000), _words(4, 120, 5_000)
    near = " ".join(w if n != 7 else "new" for n, w in enumerate(long))
    a, b = " ".join(long), " ".join(other)
    # ids 5 and 9 hold two texts each that share no word; 9 is the first of both of its texts' classes
    rows = [(1, a), (5, a), (5, b), (7, b), (8, near), (9, near + " end"), (9, "quite another text of seven words"), (5, b)]
    got = {r.doc_id: (r.class_id, r.component_id, r.n_links) for r in ngram_join.similarity_join(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    # a, near and near + end are linked with one another; ids tie a and b together
    assert got == {1: (1, 1, 2), 5: (1, 1, 2), 7: (5, 1, 0), 8: (8, 1, 2), 9: (9, 1, 2)}


def test_giant_texts_of_one_line_move_as_small_sets(spark, monkeypatch):
    line = " ".join(_words(8, 30, 500)) + " "
    rows = [(k, line * (20_000 + k)) for k in range(6)]
    sizes = []
    staged = ngram_join.stage

    def stage(frame, **options):
        written = staged(frame, **options)
        sizes.extend(f.name for f in written.schema if f.dataType.typeName() == "string")
        return written

    monkeypatch.setattr(ngram_join, "stage", stage)
    got = ngram_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_shingles, r.component_id, r.n_links) for r in got} == {(30, 0, 5)} and not sizes


def test_similarity_join_without_rows_and_one_of_each(docs, empty):
    assert ngram_join.similarity_join(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = {i for i, (_, c) in _brute_components(_texts()).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == expected | {None}


def test_random_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)] + [(None, 3)]
    lowest = {i: i for e in edges for i in e if i is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    got = {row.id: row.component for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {i for a, b in edges if a is not None and a != b for i in (a, b)}
    assert got == {i: lowest[i] for i in linked}


def test_id_filter_keeps_all_wanted(spark):
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "wanted")
    kept = {r.doc for r in only_ids(spark.range(0, 3000).withColumnRenamed("id", "doc"), "doc", ids).collect()}
    assert set(range(0, 3000, 7)) <= kept and len(kept) < 440


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(BPE)
    sizes = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in _texts()]
    limits = token_counts.context_limits(token_counts.histogram(token_counts.lengths(docs, BPE))).cache()
    rows = {r.context_limit: r for r in limits.collect()}
    assert set(rows) == set(sizes)
    for limit, row in rows.items():
        assert row.n_docs == sizes.count(limit) and row.docs_longer == sum(s > limit for s in sizes)
        assert row.tokens_kept == sum(min(s, limit) for s in sizes) and row.tokens_total == sum(sizes)
        assert row.tokens_cut == sum(sizes) - row.tokens_kept and row.docs_within == sum(s <= limit for s in sizes)
    asked = {r.context_limit: (r.tokens_kept, r.docs_longer) for r in token_counts.kept_at(limits, [1, 100, 10**6]).collect()}
    assert asked == {w: (sum(min(s, w) for s in sizes), sum(s > w for s in sizes)) for w in (1, 100, 10**6)}
    assert token_counts.quantile(limits, 0.5) == sorted(sizes)[-(-len(sizes) // 2) - 1]
    assert token_counts.context_limits(token_counts.histogram(token_counts.lengths(empty, BPE))).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    library = Tokenizer.from_file(BPE)
    folder = token_files.new_folder(spark)
    token_files.write_tokens(docs, folder, BPE, end_id=2)
    read = token_files.with_checksum(token_files.read_tokens(spark, folder)).orderBy("start").collect()
    assert len(read) == len(_texts())
    ids = [r.doc_id for r in read]
    assert ids == sorted(ids, key=lambda i: -(2**63) if i is None else i)
    at, texts = 0, {}
    for i, t in _texts():
        texts.setdefault(i, []).append(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()))
    for row in read:
        assert row.start == at and row.ids_crc32 in texts[row.doc_id]
        at += row.n_tokens
    folder = token_files.new_folder(spark)
    token_files.write_tokens(empty, folder, BPE, end_id=2)
    assert token_files.read_tokens(spark, folder).count() == 0


ODD = ["a  b", "a \n b", " x", "\n", "don't we'll 12ab! é x", "<|endoftext|>hi", "x ", " ", "a　b ñÑ'S", "it's 'sx ''s", "²³ x² ª a", "a,b. c,", "日本 語"]


def test_encoders_equal_their_libraries():
    own, model = token_counts.encoder(BPE), sentencepieces.pieces(PIECES)
    for text in [*ODD, *(t for _, t in _texts() if t)]:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == own.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(model.encode(text), "<u4").tolist() == model.library.encode(text)
        assert model.decode(model.encode(text)) == text


@pytest.mark.parametrize("chunk", [5, 64])
def test_giant_texts_are_encoded_as_in_one_piece(spark, chunk):
    r = random.Random(2)
    texts = ["".join(r.choice("abet ñ in\n") for _ in range(200)) for _ in range(4)] + ["x" * 150, "hello world " * 12, None, "", " " * 30]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1])], "doc_id long, text string")
    model = sentencepieces.pieces(PIECES)
    rows = sentencepieces.decode(sentencepieces.encode(frame, PIECES, chunk=chunk), PIECES).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == [-1, 0, *range(len(texts))]
    for row in rows:
        text = texts[row.doc_id if row.doc_id is not None else 1] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == model.library.encode(text) and row.decoded == text


def test_max_plus_product_is_associative():
    r = random.Random(1)
    a, b, c = ([((r.randrange(4), 1), (r.randrange(4), 1)) for _ in range(6)] for _ in range(3))
    one = sentencepieces.joined
    assert one(one(a, b), c) == one(a, one(b, c))


def test_license_scan(spark, empty):
    mit = licenses.TEMPLATES["mit"][0]
    texts = [
        "Released under the MIT License.", "x under the mit license; under\nthe-MIT license", "Licensed under the Apache License, Version 2.0.",
        "CC BY-NC 4.0", mit.upper(), mit.replace("without limitation", "with no odd limitation"), "nothing here", "", None, "under the mit",
        "under the mit lıcense K", "éunder the mit license",
    ]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[0])], "doc_id long, text string").withColumn("label", F.lit(1))
    rows = licenses.scan(frame).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r for r in rows}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [(k, l) for p, l in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert got[i].n_words == len(w) and got[i].n_base == len(places), text
        assert got[i].base_labels == ",".join(sorted({l for _, l in places}))
        assert (got[i].first_word, got[i].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert got[4].labels == "mit" and got[5].labels == "mit" and 0.7 <= got[5].score < 1 and got[6].score == 0 and got[None].n_base == 1
    assert licenses.scan(empty).count() == 0


def test_fingerprints(docs, empty, spark):
    rows = fingerprints.edited_pairs(docs).collect()
    assert len(rows) == len(_texts())
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in _texts()), key=lambda x: (-x[0], x[1]))
    expected = []
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = (t[: len(t) - half] + other[:half]).encode()
        print_ = fingerprints.fingerprint
        expected.append((
            None if i == -(2**63) else i, len(t), hashlib.sha256(edited).hexdigest(), print_(t.encode()), print_(edited),
            fingerprints.likeness(print_(t.encode()), print_(edited)), fingerprints.likeness(print_(t.encode()), print_(other.encode())),
        ))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert fingerprints.edited_pairs(empty).count() == 0
    one = fingerprints.edited_pairs(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprints(docs.limit(3)).where("fingerprint is null").count() == 0


def _brute_hits(texts, items, phrase=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            own = cut(text)
            n = min(phrase, len(own))
            for s in range(len(own) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == own[s : s + n]:
                        hit |= set(range(k, k + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark, empty, docs):
    item = _words(70, 25)
    items = [(1, " ".join(item)), (2, "short item"), (10, "..."), (11, None), (12, "a a a a a a a a a a a"), (2, " ".join(_words(71, 14)))]
    texts = [
        (1, "x " + " ".join(item[3:14]) + " y short, ITEM"), (2, " ".join(item[:9])), (3, " ".join(item)), (4, "a " * 15), (5, None), (6, ""),
        (7, " ".join(reversed(item[:10]))), (3, " ".join(item)), (None, "short item"), (8, "short"), (9, "item"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("segment", F.lit(0))
    found = decontamination.contamination(frame, bench).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found), key=str)
    assert got == sorted(_brute_hits(texts, items), key=str)
    assert {r.doc_id: r.n_near_items for r in found}[7] == 1
    kept = decontamination.without_contaminated(frame, bench)
    assert {r.doc_id for r in kept.collect()} == {2, 5, 6, 7, 8, 9} and kept.columns == frame.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(frame, none).where("n_hit > 0").count() == 0
    assert decontamination.contamination(empty, bench).count() == 0
    index = decontamination.build_index(frame, segment_words=10)
    small = decontamination.report(index, decontamination.matches(index, bench))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in small.collect()), key=str) == got


def test_decontamination_query_reports_proximity(spark, tmp_path):
    item = _words(70, 10, 1000)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, " ".join(reversed(item))), (2, " between ".join(item)), (3, " ".join(item[:9])), (4, " ".join(item))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op7_decontamination(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_near_items, r.contaminated) for r in found} == {1: (1, False), 2: (1, False), 3: (0, False), 4: (1, True)}


def test_decontamination_proximity_of_every_phrase(spark):
    a, b = _words(70, 19, 1000), _words(71, 27, 1000)
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, "two words")]
    texts = [
        (1, " ".join(reversed(a[5:15]))), (2, " ".join(reversed(b[17:]))), (3, " ".join(a[5:14])),
        (4, " x x x ".join(a[9:])), (5, " x x x x ".join(a[9:])), (6, "words x two " + " y ".join(b[4:14])),
        (7, "words " + "x " * 39 + "two"), (8, "words " + "x " * 40 + "two"), (9, None), (10, " ".join([b[0]] * 30 + a[3:13])),
    ]
    expected = {}
    for i, t in texts:
        w = (t or "").split()
        stretches = [set(w[s : s + 2 * decontamination.SLOP + 1]) for s in range(len(w))]
        own = [(k, x.split()) for k, x in items]
        expected[i] = len({k for k, x in own for s in range(max(1, len(x) - 9)) if any(set(x[s : s + 10]) <= e for e in stretches)})
    assert expected == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 2, 7: 1, 8: 0, 9: 0, 10: 1}
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for segment_words in (1, 60, 1000):
        index = decontamination.build_index(frame.coalesce(1), segment_words=segment_words)
        found = decontamination.report(index, decontamination.matches(index, bench)).collect()
        assert {r.doc_id: r.n_near_items for r in found} == expected


def test_profiles_never_hide_a_similar_pair():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 31, 64, 400, 3000):
        for changed in (0, 1, n // 10, n // 5, n):
            for more in (0, n // 5):
                base = r.integers(0, 2**64, n, np.uint64)
                other = np.concatenate([base[changed:], r.integers(0, 2**64, changed + more, np.uint64)])
                for a, b in ((base, other), (other, base), (base >> np.uint64(7), other >> np.uint64(7))):
                    a, b = np.unique(a), np.unique(b)
                    most = ngram_join._most_shared(ngram_join._profile(a), ngram_join._profile(b))
                    assert most >= len(np.intersect1d(a, b))
    a, b = (np.unique(r.integers(0, 2**64, 400, np.uint64)) for _ in range(2))
    assert 180 * ngram_join._most_shared(ngram_join._profile(a), ngram_join._profile(b)) < 80 * 800


def test_sharding_law(docs, empty, spark):
    many = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.repeat(F.lit("ä"), (F.col("id") % 90).cast("int"))).alias("text"),
    )
    for frame, tolerance in ((many, 0.01), (docs, None)):
        rows = sharding.shard_rows(frame, 8, cell_rows=50).collect()
        assert len(rows) == frame.count()
        by_shard = {}
        for r in rows:
            assert r["size"] == len((r.text or "").encode()) + 1
            by_shard.setdefault(r.shard, []).append(r)
        assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by_shard.values()) and set(by_shard) <= set(range(8))
        if tolerance:
            sizes = [sum(r["size"] for r in own) for own in by_shard.values()]
            assert len(sizes) == 8 and max(sizes) - min(sizes) <= tolerance * sum(sizes) / 8 + 2 * 200
    assert sharding.shard_rows(empty, 8).count() == 0


def test_sharding_law_with_repeated_rows(spark):
    alike = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same row").alias("text"))
    without = spark.range(1500).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    others = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    frame = alike.union(without).union(others).withColumn("shard", F.lit("x")).withColumn("_repeat", F.lit(1)).withColumn("_key", F.lit("k"))
    rows = sharding.shard_rows(frame, 8, cell_rows=100).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r.doc_id), str(r.text)) for r in frame.collect())
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by_shard.values())
    sizes = [sum(r["size"] for r in own) for own in by_shard.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.002 * sum(sizes) / 8 + 2 * 21


def _labelled(spark):
    rows, labels = [], []
    for i in range(400):
        bad, poor = i % 4 == 0, i % 5 == 0
        text = " ".join(_words(i, 30)) + (" you stupid idiot" if bad else "")
        rows.append((i, text.upper().replace(" ", "!! ") if poor else text, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None))
        labels.append((i, int(not poor), int(bad)))
    rows += [(900, None, "en", "s0"), (901, "", "en", "s0"), (None, "you moron", None, None), (1, rows[1][1], "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("label", F.lit("x"))
    return docs, spark.createDataFrame([*labels, (5, None, None), (7777, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_on_held_out_documents(spark, empty):
    docs, labels = _labelled(spark)
    report = toxicity.report(docs, labels).collect()
    assert len(report) == docs.count() and all(0 <= r.score <= 1 for r in report)
    held = [r for r in report if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in report if r.doc_id is not None)
    assert len(held) > 40 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held if r.doc_id < 400)
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    scored = quality.quality(docs, labels).collect()
    assert len(scored) == docs.count()
    assert all((r.quality >= 0.5) == (r.doc_id % 5 != 0) for r in scored if r.doc_id is not None and r.doc_id < 400)
    assert all(0 < r.host_posterior < 1 and 0 < r.path_posterior < 1 for r in scored)
    none = labels.limit(0)
    assert toxicity.without_toxic(docs, none).count() == docs.count() == quality.good_ones(docs, none).count()
    assert toxicity.report(empty, labels).count() == 0 and quality.good_ones(empty, labels).count() == 0


def test_posteriors_equal_a_plain_recomputation_without_the_own_document(spark):
    docs, labels = _labelled(spark)
    alone = spark.createDataFrame([(990, "some words of a lone site", "lv", "lone")], "doc_id long, text string, lang string, source string")
    rows = quality.quality(docs.unionByName(alone.withColumn("label", F.lit("x"))).withColumn("_n", F.lit(3)), labels).collect()

    def sums(of):
        out = {}
        for r in rows:
            n, good = out.get(of(r), (0, 0.0))
            out[of(r)] = (n + 1, good + r.evidence)
        return out

    def strength(groups, center):
        total = sum(n * (good / n - center(k)) ** 2 for k, (n, good) in groups.items())
        chance = sum(center(k) * (1 - center(k)) for k in groups) / len(groups)
        between = (total - len(groups) * chance) / sum(n for n, _ in groups.values())
        return quality.STRONGEST if between <= 0 else min(quality.STRONGEST, max(1.0, chance / between - 1))

    hosts, paths = sums(lambda r: r.source), sums(lambda r: (r.source, r.lang))
    corpus = sum(r.evidence for r in rows) / len(rows)
    w = strength(hosts, lambda k: corpus)
    parent = {k: (good + w * corpus) / (n + w) for k, (n, good) in hosts.items()}
    v = strength(paths, lambda k: parent[k[0]])
    logit = lambda p: np.log(p / (1 - p))
    for r in rows:
        n, good = hosts[r.source]
        host = (good - r.evidence + w * corpus) / (n - 1 + w)
        n, good = paths[r.source, r.lang]
        path = (good - r.evidence + v * host) / (n - 1 + v)
        assert r.host_posterior == pytest.approx(host, abs=1e-6) and r.path_posterior == pytest.approx(path, abs=1e-6)
        assert r.quality == pytest.approx(1 / (1 + np.exp(-(logit(r.evidence) + logit(path) - logit(corpus)))), abs=1e-6)
    lone = next(r for r in rows if r.doc_id == 990)
    assert lone.path_posterior == pytest.approx(corpus, abs=1e-6) == pytest.approx(lone.host_posterior, abs=1e-6)
    assert lone.quality == pytest.approx(lone.evidence, abs=1e-6) and lone._n == 3


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "en", 0.9)] * 900 + [("bad", "en", 0.1)] * 300 + [("one", "en", 0.1), ("bad", "fr", 0.9)]
    frame = spark.createDataFrame(rows, "source string, lang string, evidence double")
    got = {(r.source, r.lang): r for r in quality.site_posteriors(frame).collect()}
    assert got["bad", "en"].host_posterior < 0.2 < 0.3 < got["one", "en"].host_posterior < got["big", "en"].host_posterior
    assert got["bad", "fr"].path_posterior < 0.6


def test_trees_and_isotonic():
    r = np.random.default_rng(1)
    rows = r.random((600, 3))
    labels = ((rows[:, 0] > 0.5) & (rows[:, 1] > 0.3)).astype(float)
    trees = boosting.fit_trees(rows[:400], labels[:400])
    margin = trees.margin(rows[400:])
    assert ((margin > 0) == labels[400:]).mean() > 0.95
    curve = boosting.fit_isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(curve.share) >= 0).all() and curve.share[0] == 0 and curve.share[-1] == 1
    assert boosting.fit_trees(rows[:5], np.ones(5)).margin(rows[:2]).shape == (2,)


def test_rows_without_some_ids_are_not_moved(spark, tmp_path):
    """The anti join by a bitmap gives the plain one's rows, and shuffles only those whose id may be among the ids."""
    rows = spark.range(20_000).select("id", F.repeat(F.lit("x"), 50).alias("wide")).repartition(4)
    ids = spark.createDataFrame([(k,) for k in (*range(0, 20_000, 1_000), 99_999)], "away long")
    left = without_ids(rows, "id", ids)
    assert [r.id for r in left.select("id").orderBy("id").collect()] == [k for k in range(20_000) if k % 1_000]
    assert left.columns == ["id", "wide"]
    assert without_ids(rows, "id", ids.where("false")).count() == 20_000
    unsure = only_ids(rows, "id", ids).count()
    assert 20 <= unsure < 200
