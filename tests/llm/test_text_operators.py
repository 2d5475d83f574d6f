"""Text operators against brute force on small tables with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.llm import common, decontam, jaccard, langid, packing, pii, secret_scan, syncmers, token_counts, tokens, toxicity, url_filter

WORDS = [f"w{i}{c}" for i in range(300) for c in "ab"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def prose(seed: int, n: int) -> str:
    """Words made of common syllables: what a model of ordinary identifiers needs some of."""
    r = random.Random(seed)
    parts = ["the", "and", "ing", "er", "tion", "an", "re", "on", "ed", "st", "en", "at", "is", "or", "al", "ly", "men", "con", "pro"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    base = sentence(1, 80)
    words = base.split(" ")
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows = [(1, base, "en"), (2, base, "en"), (3, near, "en"), (4, sentence(2, 60), "de"), (5, None, None), (6, "", "en"), (7, "!!! ???", "en"), (8, "one two", "en"), (9, "ONE  two", "en"), (10, sentence(3, 5000), "fr"), (10, sentence(3, 5000), "fr"), (None, sentence(9, 30), None)]
    return docs_of(spark, rows)


def clashing(df):
    """Extra columns named like the operators' own."""
    out = df
    for name in ("set_key", "bucket", "score", "spans", "hits", "next_text", "_guest", "salt", "h"):
        out = out.withColumn(name, F.lit("x"))
    return out


def shingle_set(text, k=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_shingles_match_brute_force():
    texts = ["", "a", "a b c d", "a b c d e", sentence(4, 50), "x!y z", "a b c d e f"]
    values, starts = common.shingles(texts)
    sets = [set(values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert len(sets[3] & sets[6]) == 1


def test_jaccard_classes_match_brute_force(spark, corpus):
    rows = [(r.doc_id, shingle_set(r.text)) for r in corpus.where("doc_id is not null").collect()]
    got = {r.doc_id: r for r in jaccard.jaccard_classes(clashing(corpus.where("doc_id is not null"))).collect()}
    for i, (doc, s) in enumerate(rows):
        links = sum(1 for j, (_, o) in enumerate(rows) if j != i and jac(s, o) >= 0.8)
        assert got[doc].n_links == links, doc
    assert got[1].class_id == got[2].class_id == got[3].class_id == 1
    assert got[8].class_id == got[9].class_id == 8
    assert got[5].n_links == got[7].n_links == 0
    assert jaccard.jaccard_classes(corpus).count() == corpus.count()
    kept = sorted(r.doc_id for r in jaccard.keep_one(corpus.where("doc_id is not null")).collect())
    assert kept == [1, 4, 5, 6, 7, 8, 10]


def test_jaccard_blocks_and_random_groups(spark):
    r, rows = random.Random(5), []
    for g in range(4):
        base = sentence(100 + g, 120).split(" ")
        for c in range(40):
            words = base.copy()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"new{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words), "en"))
    sets = [shingle_set(t) for _, t, _ in rows]
    brute = [sum(1 for j, o in enumerate(sets) if j != i and jac(s, o) >= 0.8) for i, s in enumerate(sets)]
    got = {x.doc_id: x.n_links for x in jaccard.jaccard_classes(docs_of(spark, rows), block=8).collect()}
    assert sum(got.values()) >= 0.995 * sum(brute)
    assert all(got[i] <= n for i, n in enumerate(brute))


def test_banding_reaches_recall():
    bands, rows = jaccard.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    assert bands * rows <= 128


def test_contamination_matches_brute_force(spark, corpus):
    long_text = sentence(3, 5000)
    items = [(1, " ".join(long_text.split(" ")[700:730])), (2, " ".join(sentence(1, 80).split(" ")[5:25])), (3, None), (4, ""), (5, "one two"), (6, sentence(77, 20)), (2, " ".join(sentence(1, 80).split(" ")[5:25]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = corpus.where("doc_id is not null")
    expected = set()
    for d in docs.collect():
        for i, t in items:
            s = shingle_set(t)
            if s and len(s & shingle_set(d.text)) / len(s) >= 0.8:
                expected.add((d.doc_id, i))
    got = [(r.doc_id, r.item_id) for r in decontam.contamination(clashing(docs), table).collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert decontam.contamination(docs, table.where("false")).count() == 0
    assert decontam.decontaminate(docs, table).columns == docs.columns


def test_pii_rules_and_discovery(spark):
    texts = [
        "mail a.b@c-d.example.org, call +1 (212) 555-0100 now", "4111 1111 1111 1111 and 4111111111111112", "1.2.3.4 999.1.1.1 1.2.3.4.5 01.002.3.4", "x@y x@@y.z a@b.c@d.e", "", None, "é😀 é@x.yz me@x.yz 😀", "+12345678 +1-2-3-4-5-6-7-8-9",
        "a" * 5000 + "@x.com", "1-2 3-4 55 4012888888881881",
    ]
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(clashing(docs))).collect()}
    for i, t in enumerate(texts):
        spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "")]
        spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t or "") if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t or ""):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
                spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t or "") if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t, got[i].spans, text)


def test_pii_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"{sentence(i, 8)} reach her at p{i}@mail{i}.example.com today {sentence(i + 50, 8)}", "en") for i in range(30)]
    rows.append((30, f"{sentence(1, 6)} reach her at user#7731 today {sentence(2, 6)}", "en"))
    rows.append((31, f"{sentence(1, 6)} 42 apples {sentence(2, 6)}", "en"))
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs_of(spark, rows))).collect()}
    assert got[30].n_context == 1 and got[31].n_context == 0
    assert pii.find_pii(docs_of(spark, rows).where("false")).count() == 0


def test_language_profiles(spark):
    r = random.Random(3)
    words = {"en": ["the", "and", "thing", "with", "other"], "de": ["der", "und", "nicht", "schön", "über"], "ru": ["это", "не", "она", "был", "что"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang) for i in range(200) for lang in [list(words)[i % 3]]]
    rows += [(1000, None, None), (1001, "", None), (1002, "12 34 !!", None), (1003, "𝒜𝒷 the and thing with other", None), (1004, "the", None)]
    got = {x.doc_id: x for x in langid.identify(clashing(docs_of(spark, rows)).drop("lang").withColumn("lang", F.element_at(F.array(F.lit(None).cast("string"), *[F.lit(x) for x in words]), F.when(F.col("doc_id") < 1000, (F.col("doc_id") % 3 + 2).cast("int")).otherwise(1)))).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200])
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1004].lang_pred == "en" and all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    docs = docs_of(spark, rows)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, *_ in rows if i not in (1000, 1001, 1002)}
    assert {x.lang_pred for x in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gram_counts_match_brute_force():
    texts = ["Ab, ab!", "", "aß É", "x"]
    row, gram, count = langid.gram_counts(texts)
    for i, t in enumerate(texts):
        want = {}
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f" {w} "
            for n in (1, 2, 3):
                for a in range(len(padded) - n + 1):
                    g = padded[a : a + n]
                    if n == 1 and g == " ":
                        continue
                    want[g] = want.get(g, 0) + 1
        got = {}
        for g, c in zip(gram[row == i].tolist(), count[row == i].tolist(), strict=True):
            units = []
            while g:
                units.append(g & 0xFFFF)
                g >>= 16
            got["".join(map(chr, units[::-1]))] = c
        assert got == want, t


def test_fingerprints(spark, corpus):
    rows = sorted(((r.doc_id, r.text or "") for r in corpus.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()), reverse=True)
    docs = docs_of(spark, [(i, t, "en") for i, t in rows])
    got = {r.doc_id: r for r in syncmers.edited_neighbours(clashing(docs)).collect()}
    for k, (i, t) in enumerate(rows):
        following, cut = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0
    assert got[3].near_next > 0.5 and got[4].near_next < 0.1
    assert got[6].fingerprint == "" and got[6].near_next in (0.0, 1.0)
    assert syncmers.edited_neighbours(corpus).count() == corpus.count()
    assert syncmers.edited_neighbours(docs.where("false")).count() == 0


def test_syncmers_are_context_free(spark):
    passage = sentence(8, 60)
    docs = docs_of(spark, [(1, f"{sentence(20, 30)} {passage} {sentence(21, 40)}", "en"), (2, passage, "en"), (3, sentence(22, 90), "en")])
    anchors = {i: {} for i in (1, 2, 3)}
    for r in syncmers.anchor_rows(docs).collect():
        anchors[r.doc_id][r.anchor] = r.position
    shared = anchors[1].keys() & anchors[2].keys()
    assert shared == anchors[2].keys() and {anchors[1][a] - anchors[2][a] for a in shared} == {30}
    assert 0.3 < len(anchors[2]) / 56 < 0.7


def test_secrets(spark):
    secret = "Zk9dQ2x7Vb3NfT1rLw8PqY6h"
    texts = ['x password = "abcdefgh1" y', "PASSWORD:short", "token='" + "a1" * 20 + "'", "AKIA" + "ABCDEFGHIJKL" + " AKIA123", "0123456789abcdef" * 2 + "g", "", None, f"key {secret} é", "ordinary words of_identifiers and camelCase", "api_key=abc.def/ghi==", "😀 token: deadbeefdeadbeef"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, prose(i, 3000), "en") for i in range(20)]
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.secret_spans(clashing(docs_of(spark, rows)))).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t or "") if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
    assert got[7].spans == f"random:4:{4 + len(secret)}"
    assert all(got[100 + i].spans == "" for i in range(20)) and got[8].spans == ""
    docs = docs_of(spark, rows)
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns
    texts_out = {r.doc_id: r.text for r in clean.collect()}
    assert texts_out[7] == "key [SECRET] é" and texts_out[6] is None and texts_out[100] == prose(0, 3000)


def brute_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary()).encode(text, add_special_tokens=False).ids


def test_token_ids_equal_the_tokenizer():
    texts = ["", " ", "Hello  world\n\n", "naïve café 漢字 😀", "x" * 500, "don't we'll\t tabs", "a b", "12345 678,90"]
    assert all(tokens.encode(t, tokens.default_vocabulary()).tolist() == brute_ids(t) for t in texts)


def test_token_counts(spark, corpus):
    lengths = [len(brute_ids(r.text or "")) for r in corpus.collect()]
    limits = token_counts.context_limits(token_counts.length_histogram(clashing(corpus)))
    rows = {r.length: r for r in limits.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n) and r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
    for limit in (0, 1, 50, 700, 10**6):
        assert token_counts.truncated_total(limits, limit).first().tokens == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(limits, 0.5).first().length == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.context_limits(token_counts.length_histogram(corpus.where("false"))).count() == 0


def test_packing_is_a_round_trip(spark, corpus):
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate([*(r.text for r in corpus.collect()), *(sentence(200 + k, 37 * k) for k in range(60))])])
    pieces = packing.pack(clashing(docs), window=256).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(pieces.doc_id) == set(texts)
    for doc, part in pieces.groupby("doc_id"):
        ids, at = np.array([*brute_ids(texts[doc]), 1], dtype="<u4"), 0
        for p in part.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        total = int(part.length.sum())
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and total <= 256 and (total == 256 or total & (total - 1) == 0)
    assert packing.pack(docs.where("false")).count() == 0


def test_sum_of_squares_choice_is_the_minimum():
    r = random.Random(2)
    levels, fills = packing.Levels(32), []
    for k in range(300):
        size = r.randint(1, 31)
        counts = [fills.count(h) for h in range(33)]

        def cost(h, size=size, counts=counts):
            after = counts.copy()
            if h:
                after[h] -= 1
            after[h + size] += 1
            return sum(c * c for c in after[1:32])

        options = [h for h in range(33 - size) if h == 0 or counts[h]]
        best = min(cost(h) for h in options)
        full = levels.place((k, 0, np.zeros(size, dtype=np.uint32), size))
        after = [0 if h in (0, 32) else int(levels.counts[h]) for h in range(33)]
        assert sum(c * c for c in after) == best
        fills = [h for h in range(1, 32) for _ in range(after[h])]
        assert full is None or sum(len(p[2]) for p in full) == 32


def test_toxicity(spark):
    r, rows, labels = random.Random(1), [], []
    for i in range(300):
        words = sentence(i, 60).replace("w", "").split(" ")
        words = ["".join(chr(97 + (ord(c) - 48) % 26) if c.isdigit() else c for c in w) + "ly" for w in words]
        toxic = i % 3 == 0
        if toxic:
            words[r.randrange(60)] = r.choice(["nastyterm", "badword", "b4dw0rd", "nаstyterm"])
            words[r.randrange(60)] = "badword"
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en"), (901, "", "en"), (902, "so B@DW0RD here " + rows[1][1], "en"), (902, "so B@DW0RD here " + rows[1][1], "en")]
    docs, labelled = clashing(docs_of(spark, rows)).drop("score"), spark.createDataFrame([*labels, (0, 1, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labelled).collect()}
    assert all(got[i].predicted == y for i, _, y in labels)
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i in got)
    assert {x.predicted for x in toxicity.toxicity(docs, labelled.where("false")).collect()} == {0}


def test_exception_phrases_and_folding():
    automaton = toxicity.build({"=trash": 3.0, "^idio": 2.0}, ["trash can"])
    weight = lambda text: sum(w for _, w in automaton.iter_long(toxicity.haystack(toxicity.folded_words(text))))
    assert weight("trash") == 3 and weight("the trash can") == 0 and weight("trash trash") == 6
    assert weight("1d10t idiotic 2024") == 4 and weight("іdiоt") == 2 and weight("atrash") == 0


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    pages = [
        (1, "https://A.Example.net/en/1", link("good.com")), (2, "http://b.net/x", None), (3, "http://b.net", link("bad.com")), (4, "https://x.example.com/de/1?q", ""), (5, "https://y.org/fr/", link("good.com")), (6, None, None), (7, "no scheme", None),
        (8, "https://good.com/a#b", link("y.org")), (9, "https://bad.com/a", link("b.net")), (10, "https://example.com/fr/", None), (11, "https://worse.com/?x", link("bad.com")), (5, "https://y.org/fr/", link("good.com")), (12, "http://b.net/z", None),
    ]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2].rule == "net/" and got[2].verdict == "block" and got[3].rule is None and got[3].path == ""
    assert got[4].rule == "example.com/de/" and got[5].rule == "org/fr/"
    assert (got[6].host, got[6].path, got[6].verdict) == ("", "", "allow") and got[7].host == ""
    assert got[8].verdict == "allow" and got[9].verdict == "block" and got[11].verdict == "block" and got[10].verdict == "allow"


def test_pagerank_matches_brute_force(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]
    links = spark.createDataFrame([(s, d, 1) for s, d in edges], "src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double")
    got = {r.host: r.rank for r in url_filter.propagate(links, seeds, 0.85, 30).where("kind = 'trust'").collect()}
    names, rank = "abcd", np.array([1.0, 0, 0, 0])
    m = np.zeros((4, 4))
    for s, d in edges:
        m[names.index(d), names.index(s)] = 1 / sum(x == s for x, _ in edges)
    for _ in range(30):
        rank = 0.85 * m @ rank + 0.15 * np.array([1.0, 0, 0, 0])
    assert all(abs(got.get(n, 0) - rank[i]) < 1e-9 for i, n in enumerate(names))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[102] == 100


def test_pipeline_and_empty_tables(spark, corpus, tmp_path):
    import corpus_pipeline

    extra = docs_of(spark, [(50, f"{sentence(60, 50)} token=abcdefgh12345678", "en"), (51, f"{sentence(61, 30)} {sentence(70, 25)} {sentence(62, 30)}", "en")])
    docs = corpus.where("doc_id is not null").unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, sentence(70, 25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept = {1: sentence(1, 80), 4: sentence(2, 60), 8: "one two", 10: sentence(3, 5000), 50: f"{sentence(60, 50)} [SECRET]"}
    assert set(out.doc_id) == set(kept)
    for doc, part in out.groupby("doc_id"):
        ids = np.array([*brute_ids(kept[doc]), 1], dtype="<u4")
        assert part.length.sum() == len(ids) and all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in part.itertuples())
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
