"""The methods themselves against brute force, planted cases, hot groups, and the cases that were once missed."""

import random
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_ids, clashing, docs_of, prose, sentence

from factorlake.llm import common, decontam, jaccard, langid, packing, pii, secret_scan, syncmers, tokens, toxicity, url_filter


def test_added_tokens_keep_their_ids(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x<|endoftext|>y", "<|endoftext |> <|endof"]
    assert all(tokens.encode(t, tokens.default_vocabulary()).tolist() == brute_ids(t) for t in texts)
    assert tokens.lengths(texts, tokens.default_vocabulary()) == [len(brute_ids(t)) for t in texts]
    pieces = packing.pack(docs_of(spark, [(1, texts[0], "en")])).toPandas().sort_values("start")
    ids = np.array([*brute_ids(texts[0]), 1], dtype="<u4")
    assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces.itertuples())


@pytest.mark.parametrize("sizes", [[1500] * 400, list(range(1, 2047)), [700, 1400, 2000, 3] * 90])
def test_partial_windows_keep_what_the_levels_gave(sizes):
    levels, full = packing.Levels(2048), []
    for doc, size in enumerate(sizes):
        made = levels.place((doc, 0, np.full(size, doc, dtype="<u4"), size))
        full += [made] if made else []
        if levels.held() > 100:
            full += levels.drain(last=False)
            assert levels.held() <= 1
    full += levels.drain(last=True)
    seen = Counter()
    for window in full:
        total = sum(len(p[2]) for p in window)
        assert total == 2048 or (total < 2048 and total & (total - 1) == 0)
        for doc, start, ids, size in window:
            assert (ids == doc).all() and size == sizes[doc] and start + len(ids) <= size
            seen.update((doc, at) for at in range(start, start + len(ids)))
    assert len(seen) == sum(sizes) and set(seen.values()) == {1}
    assert sum(sum(len(p[2]) for p in w) < 2048 for w in full) <= 11


def test_pii_needs_a_cue_on_one_side_only(spark):
    r = random.Random(7)
    seeds = [(i, f"{sentence(i, 6)} reach me at {r.choice(['p%d@mail.example.com', '10.0.%d.7'])} {sentence(500 + i, 6)}" % i, "en") for i in range(60)]
    unseen = [(100 + i, f"{sentence(900 + i, 6)} reach me at handle#{i}77 {sentence(1200 + i, 6)}", "en") for i in range(12)]
    clean = [(200 + i, f"{sentence(1500 + i, 9)} chapter {i} verse {i + 3} {sentence(1800 + i, 6)}", "en") for i in range(60)]
    nameless = [(None, unseen[0][1] + " end", "en"), (None, unseen[1][1] + " end", "en"), (100, clean[0][1], "en")]
    rows = pii.digest(pii.find_pii(docs_of(spark, [*seeds, *unseen, *clean, *nameless]))).collect()
    found = {x.doc_id for x in rows if x.n_context}
    assert len(rows) == 135 and sum(x.n_context for x in rows if x.doc_id is None) == 2
    assert len([i for i, *_ in unseen if i in found]) >= 11 and not any(i in found for i, *_ in clean)
    assert all(x.n_spans == x.n_email + x.n_ip + x.n_card + x.n_phone + x.n_context for x in rows)


def test_pii_is_linear_in_the_text(spark):
    texts = [" ".join(map(str, range(60_000))), "1 " + "x" * 300_000 + " 2", "1 " + "x y " * 100_000]
    began = time.time()
    assert pii.digest(pii.find_pii(docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)]))).count() == 3
    assert time.time() - began < 60


def test_positions_are_sums_of_lengths(spark):
    lengths = [random.Random(1).randint(0, 9) for _ in range(1000)]
    for n in (1, 2, 255, 256, 257, 1000):
        df = spark.createDataFrame([(lengths[:n],)], "x array<int>")
        assert df.select(pii.sums_before(F.col("x")).alias("s")).first().s == np.concatenate([[0], np.cumsum(lengths[: n - 1])]).astype(int).tolist()


def test_anchors_match_brute_force(spark):
    texts = {1: sentence(8, 60), 2: "one two", 3: "", 4: sentence(9, 5), 5: "字" * 40, 6: "abc " * 30}
    units = {i: [u for w in t.split() for u in ([w] if len(w) <= 16 else list(w))] for i, t in texts.items()}
    pairs = {(a, b) for u in units.values() for a, b in zip(u, u[1:], strict=False)}
    hashed = spark.createDataFrame(sorted(pairs), "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()
    smer = {(r.a, r.b): r.h for r in hashed}
    got = {i: [] for i in texts}
    for r in syncmers.anchor_rows(docs_of(spark, [(i, t, "en") for i, t in texts.items()])).orderBy("doc_id", "position").collect():
        got[r.doc_id].append(r.position)
    for i, u in units.items():
        m = [smer[p] for p in zip(u, u[1:], strict=False)]
        want = [k for k in range(len(u) - 4) if min(m[k], m[k + 3]) <= min(m[k + 1], m[k + 2])]
        assert got[i] == (want or ([0] if u else [])), i


def test_likeness_and_alignment(spark):
    passage, other = sentence(8, 100), sentence(9, 100)
    rows = [(5, f"{sentence(1, 40)} {passage}", "en"), (4, f"{sentence(2, 13)} {passage}", "en"), (3, other, "en"), (2, other, "en"), (1, "", "en"), (0, None, "en")]
    got = {r.doc_id: r for r in syncmers.edited_neighbours(docs_of(spark, rows)).collect()}
    assert 0.4 < got[5].aligned_next <= got[5].near_next < 1 and got[4].near_next < 0.05
    assert got[3].near_next == got[3].aligned_next == 1 and got[3].fingerprint == got[2].fingerprint and got[1].near_next == 1 and got[2].near_next == 0
    prints = {r.doc_id: {x.split("+")[0] for x in r.fingerprint.split(" ")} for r in got.values()}
    assert got[5].near_next == pytest.approx(len(prints[5] & prints[4]) / len(prints[5] | prints[4]))


def test_neighbours_with_hot_and_null_ids(spark):
    rows = [(7 if i < 300 else None if i < 500 else i, f"text {i} {sentence(i, 8)}", "en") for i in range(900)]
    got = syncmers.edited_neighbours(docs_of(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in rows)
    assert len({r.edited_sha256 for r in got}) == 900  # every text follows one other


def test_ratio_matches_brute_force_and_finds_planted_secrets(spark):
    r = random.Random(3)
    gain = np.random.default_rng(1).normal(size=(secret_scan.N, secret_scan.N)) * 3
    texts = ["".join(r.choice("ab9Z_=. é\n") for _ in range(200)) for _ in range(30)] + ["", "x", "é"]
    for text, spans in zip(texts, secret_scan.likely_secrets(texts, gain), strict=True):
        want, at = [], 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in secret_scan.SYMBOLS and text[end] != ".":
                end += 1
            codes = [secret_scan.SYMBOLS.index(c) + 1 for c in text[at:end]]
            if end > at and sum(gain[a, b] for a, b in zip(codes, codes[1:], strict=False)) >= -np.log(secret_scan.PRIOR):
                want.append((at, end))
            at = max(end, at + 1)
        assert spans == want
    alphabets = [string.ascii_letters, *[string.ascii_letters + string.digits] * 9]
    plants = {i: "".join(r.choice(alphabets[i % 10]) for _ in range(r.randint(18, 30))) for i in range(60)}
    pangrams = "The Quick Brown Fox Jumps Over A Lazy Dog. My Vivid Wizards Kept Six Blue Jugs Near Old Paper Files " * 20
    rows = [(i, f"{pangrams} {prose(i, 300)} {s} {prose(i + 1, 100)}", "en") for i, s in plants.items()] + [(100 + i, prose(i, 900) + " token=0123456789abcdef0123", "en") for i in range(40)]
    got = {x.doc_id: x for x in secret_scan.secret_spans(docs_of(spark, rows)).collect()}
    assert sum("random" in got[i].kinds for i in plants) >= 57 and not any("random" in got[i].kinds for i in range(100, 140))


def test_distance_matches_brute_force():
    r = random.Random(2)
    texts = ["the house and the water", "das haus und das wasser", "x", ""]
    tables = []
    for name in ("aa", "bb"):
        grams = sorted({int(g) for t in texts[:2] for g in langid.gram_counts([t])[1]})
        ranks = list(range(len(grams)))
        r.shuffle(ranks)
        tables.append((name, np.array(grams, dtype=np.uint64), np.array(ranks, dtype=np.int64)))
    langs, scores = langid.nearest(texts, tables, 300)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        _, gram, count = langid.gram_counts([text])
        own = [g for _, g in sorted((-int(c), int(g)) for g, c in zip(gram, count, strict=True))]
        if not own:
            assert (lang, score) == ("und", 0)
            continue
        far = [sum(abs(ranks[grams.tolist().index(g)] - k) if g in grams.tolist() else 300 for k, g in enumerate(own)) for _, grams, ranks in tables]
        assert lang == tables[int(np.argmin(far))][0] and score == pytest.approx(1 - min(far) / (300 * len(own)))


def test_density_matches_brute_force():
    lexicon, exceptions = {"=trash": 3.0, "^idio": 2.0, "=asshole": 4.0, "=all": 1.5}, ["trash can"]
    density = toxicity.matcher(lexicon, exceptions)
    texts = ["", "clean words only", "trash the trash can", "IDIOTIC 1d10t", "assh01e", "ｔｒａｓｈ іdiоt", "a11 all", "so trash" + " word" * 500, "wor1d 2024 h3llo"]
    weights = [0, 0, 3, 4, 4, 5, 1.5, 3, 0]
    for text, weight, got in zip(texts, weights, density(texts), strict=True):
        assert got == pytest.approx(np.log(1 + 100 * weight / (len(toxicity.folded_words(text)) + 50))), text
    assert toxicity.matcher({}, [])(texts) == [0.0] * len(texts)


def test_toxic_terms_need_significance_not_a_share(spark):
    rows, labels = [], []
    for i in range(1500):
        text = prose(i, 40) + (" raregrub" if i % 75 == 0 else "") + (" oftenbad" if i % 3 == 0 else "") + (f" once{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" if i % 3 == 0 else "")
        rows.append((i, text, "en"))
        labels.append((i, 1, int(i % 3 == 0)))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon, _, _ = toxicity.learn(docs_of(spark, rows), labelled)
    assert "=oftenbad" in lexicon and "=raregrub" in lexicon and not any(t.startswith("=once") for t in lexicon)


def test_recall_beyond_reach_is_an_error():
    with pytest.raises(ValueError):
        jaccard.banding(0.2, 0.999999, 8)


def test_components_of_hubs_and_deep_chains(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(2999, 3000)] + [(3000 + i, 3001 + i) for i in range(200)] + [(10_000, 10_001)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(3201)) and got[10_001] == 10_000
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([("hot" if i < 900 else f"k{i}", i) for i in range(1000)], "k string, i long")
    lookup = spark.createDataFrame([("hot", 1.0), ("k950", 2.0)], "k string, w double")
    hot = common.hot_keys(rows, ["k"], 1000)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how, n in (("inner", 901), ("left", 1000)):
        got = common.join_split(rows, lookup, ["k"], hot, how).collect()
        assert len(got) == n and sum(r.w == 1.0 for r in got) == 900 and sum(r.w == 2.0 for r in got) == 1


def test_hot_keys_join_to_many_rows_of_a_key(spark):
    rows = spark.createDataFrame([(7, i) for i in range(400)] + [(i, i) for i in range(300)], "k long, i long")
    lookup = spark.createDataFrame([(7, "a"), (7, "b"), (11, "c"), (12, "d"), (12, "e"), (900, "f")], "k long, v string")
    got = sorted(map(tuple, common.join_salted(rows, lookup, ["k"], "i", 700).select("k", "i", "v").collect()))
    assert got == sorted((k, i, v) for k, i in [(7, i) for i in range(400)] + [(i, i) for i in range(300)] for kk, v in [(7, "a"), (7, "b"), (11, "c"), (12, "d"), (12, "e"), (900, "f")] if k == kk)


def test_passage_in_most_documents_is_found_everywhere(spark):
    passage, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"o{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"w{i} x{i} {passage} y{i}" if i % 4 else f"w{i} {other if i % 8 else 'none'} z{i}") for i in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, passage), (3, other), (4, "")], "item_id long, text string")
    got = sorted((x.doc_id, x.item_id) for x in decontam.contamination(docs, items).collect())
    assert got == sorted([(i, n) for i in range(400) if i % 4 for n in (1, 2)] + [(i, 3) for i in range(400) if i % 8 == 4])


def test_long_texts_in_heavy_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 500)  # every bucket of these is cut into several blocks
    base = sentence(1, 400).split(" ")
    rows = [(i, " ".join([*base[:200], f"new{i}", *base[201:]]), "en") for i in range(9)]
    got = {r.doc_id: r for r in jaccard.jaccard_classes(docs_of(spark, rows)).collect()}
    assert {r.n_links for r in got.values()} == {8} and {r.class_id for r in got.values()} == {0}


def test_empty_tables_and_long_texts(spark):
    empty = docs_of(spark, [(1, "a", "en")]).where("false")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.net/", "x")], "page_id long, url string, html string")
    assert langid.identify(empty).count() == secret_scan.secret_spans(empty).count() == toxicity.toxicity(empty, labels).count() == jaccard.jaccard_classes(empty).count() == url_filter.judge_urls(pages.where("false")).count() == 0
    long_text = " ".join(f"{prose(i, 50)} https://h{i}.org/x" for i in range(2500))
    docs = docs_of(spark, [(1, long_text, "en"), (3, prose(3, 30), "en"), (3, prose(3, 30), "en"), (None, prose(4, 30), None)])
    assert {r.lang_pred for r in langid.identify(docs).collect()} == {"en"}
    assert [r.held_out for r in langid.identify(docs).collect() if r.doc_id is None] == [None]
    assert secret_scan.secret_spans(docs).count() == toxicity.toxicity(docs, labels).count() == 4
    assert {r.class_id for r in jaccard.jaccard_classes(docs).collect()} == {1, 3, None}
    html = "".join(f'<a href="https://h{i}.org/">x</a>' for i in range(20_000))
    assert url_filter.judge_urls(pages.unionByName(spark.createDataFrame([(2, "http://b.com/", html)], pages.schema))).count() == 2


def test_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, sentence(70, 25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(docs_of(spark, [(1, sentence(1, 60), "en"), (2, sentence(1, 60), "en"), (3, f"{sentence(2, 40)} {sentence(70, 25)}", "en"), (None, sentence(5, 50), "en")]))
    docs = docs.withColumns({"row_key": F.lit(1), "_kept": F.lit(2), "_bad": F.lit(3), "doc": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = common.cut(out)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {1, None}


def test_ngram_counts_of_pieces_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    letters = list("abcdefghij klmnop qrs tuv\n\t.,ÄßИя漢字 😀𐐀İΣ ")
    texts = ["".join(rng.choice(letters, n)) for n in (0, 1, 5, 900, 20_000, 7)] + ["x" * 5_000, "".join(rng.choice(list("漢字語ΣİÄ𐐀b"), 9_000)), "a1" * 3_000, "Σ" * 2_000, "aΣ1" * 900, "̈a" * 2_000]
    whole = langid.piece_counts(list(range(len(texts))), texts, 3)
    for piece in (1, 3, 1_000, 7_000):
        monkeypatch.setattr(langid, "PIECE", piece)
        for want, got in zip(whole, langid.gram_counts(texts), strict=True):
            assert np.array_equal(want, got)


def test_a_text_without_blanks_is_counted_in_bounded_memory():
    import tracemalloc

    text = "".join(chr(0x4E00 + (i * 7919) % 3_000) for i in range(4_000_000))
    tracemalloc.start()
    row, gram, count = langid.gram_counts([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000 and int(count[gram < 65_536].sum()) == len(text)


def test_toxic_sample_has_one_row_an_id(spark):
    docs = docs_of(spark, [(1, f"copy {i}", "en") for i in range(500)] + [(i, prose(i, 5), "en") for i in range(2, 30)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels, 10).groupBy("toxic").count().collect()
    assert all(r["count"] <= 10 for r in sample) and len(sample) == 2
    assert {"=ab", "=" + "x" * 40} <= toxicity.terms_of(["ab", "x" * 40])


def test_buckets_and_patterns_that_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    r = random.Random(5)
    base = sentence(77, 60).split(" ")
    near = [" ".join([*base[:i], f"changed{i}", *base[i + 1 :]]) for i in range(0, 60, 2)]
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate([*near, *[sentence(i, 40) for i in range(100, 140)]])])
    rows = jaccard.jaccard_classes(docs).collect()
    assert sum(x.n_links > 0 for x in rows) == len(near) and {x.class_id for x in rows if x.doc_id < len(near)} == {0}
    seeds = [(i, f"{sentence(i, 6)} mail: p{i}@mail.example.com now {sentence(500 + i, 6)}", "en") for i in range(60)]
    same = [(1000 + i, f"{sentence(3000 + i, 6)} mail: user#77 now {sentence(4000 + i, 6)}", "en") for i in range(60)]
    found = pii.digest(pii.find_pii(docs_of(spark, [*seeds, *same, (2000, f"user#77 {r.random()}", "en")]))).collect()
    assert sum(x.n_context for x in found) == 60 and not any(x.n_context for x in found if x.doc_id == 2000)


def test_text_chunks_bound_characters_and_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "CHUNK_TEXTS", 3)
    texts = ["", "", "", "", "ab", "c" * 50, "", "d"]
    chunks = list(common.text_chunks(pa.array(texts), 10))
    assert [(lo, hi) for lo, hi, _ in chunks] == [(0, 3), (3, 6), (6, 8)] and [t for _, _, part in chunks for t in part] == texts
