"""Cross-tokenizer alignment against brute force over byte ranges; runs, merges and long blanks."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_text_operators import DOCS, brute_ids

from factorlake.llm import alignment, packing, queries, token_counts, tokens

A, B = tokens.default_vocabulary(), alignment.default_pieces()


def ranges(pieces):
    at, out = 0, []
    for piece in pieces:
        out.append((at, at + len(piece)))
        at += len(piece)
    return out


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha), with the library's own tokenizer for A."""
    from tokenizers import Tokenizer

    slow, (pieces, side), entries = Tokenizer.from_file(A), alignment.piece_side(B), tokens.entries(A)
    slow.encode_special_tokens = True
    counts, per_text = Counter(), []
    for text in texts:
        a = slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        whole = b" " + (text or "").encode()
        if b"".join(entries[i] for i in a) != whole or b"".join(side.bytes[i] for i in b) != whole:
            a, b = [], []
        ra, rb = ranges([entries[i] for i in a]), ranges([side.bytes[i] for i in b])
        links = [(a[i], b[j]) for i, (p, q) in enumerate(ra) for j, (r, s) in enumerate(rb) if p < s and r < q]
        ends = sorted({q for _, q in ra} & {s for _, s in rb})
        groups = [(",".join(str(a[i]) for i, x in enumerate(ra) if lo < x[1] <= hi), ",".join(str(b[j]) for j, x in enumerate(rb) if lo < x[1] <= hi)) for lo, hi in zip([0, *ends], ends)]
        per_text.append((len(a), len(b), groups, links))
        counts.update(links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    sha = lambda g: hashlib.sha256(";".join(f"{x}|{y}" for x, y in g).encode()).hexdigest() if g else ""
    return [(na, nb, len(g), len(k), sum(counts[x] == highest[x[1]] for x in k), sum(counts[x] for x in k), sha(g)) for na, nb, g, k in per_text]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def made(df):
    rows = alignment.digest(df).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


def mixed(seed, n):
    r = random.Random(seed)
    words = ["the", "tion", "Über", "漢字", "naïve", "<|endoftext|>", "<0x41>", "<s>", "\t", "\n\n", "  ", "é", "🙂", "123456", "can't", "don't", "...", "ﬁne", " ", "\x00", "supercalifragilistic", "x"]
    return [" ".join(r.choices(words, k=r.randint(0, 25))) + r.choice(["", " ", "\n"]) for _ in range(n)]


def test_alignment_matches_brute_force(spark):
    texts = [None, "", " ", "a", "▁", "a▁b", "one▁", *mixed(1, 60), "same text", "same text", "x " * 400]
    expected = brute(texts)
    assert sum(e[0] == 0 for e in expected) >= 4 and sum(e[4] != e[3] for e in expected) > 20
    assert made(alignment.align(docs_of(spark, texts))[0]) == expected


def test_many_runs_salts_and_blocks(spark, monkeypatch):
    texts = mixed(2, 120)
    for name, value in (("RUN_LINKS", 100), ("GROUP_BYTES", 2_000), ("BLOCK", 7)):
        monkeypatch.setattr(alignment, name, value)
    per_doc, pairs = alignment.align(docs_of(spark, texts), written=True)
    assert made(per_doc) == brute(texts)
    groups = [r for r in per_doc.collect() if r.n_a]
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count(";") == r.n_groups - 1 for r in groups)
    rows = pairs.collect()
    assert sum(r.n for r in rows) == sum(r.n_links for r in groups) and all(r.n <= r.highest for r in rows)


def test_runs_pack_and_merge():
    r = np.random.default_rng(3)
    for values in (np.zeros(0, dtype=np.int64), r.integers(0, 200, 50), r.integers(0, 1 << 40, 50), np.array([0])):
        assert [x.tolist() for x in alignment.unpack(alignment.pack(values, values[:1]))] == [values.tolist(), values[:1].tolist()]
    runs = [(np.unique(r.integers(0, 5_000, size)), size) for size in (0, 1, 900, 3_000, 4_000)]
    expected = Counter()
    for keys, size in runs:
        expected.update({int(k): size for k in keys})
    for block in (1, 13, 1 << 16):
        alignment.BLOCK, before = block, alignment.BLOCK
        got = [*alignment.merged([(k, np.full(len(k), size)) for k, size in runs])]
        alignment.BLOCK = before
        keys, counts = (np.concatenate(x) for x in zip(*got, strict=True))
        assert keys.tolist() == sorted(expected) and counts.tolist() == [expected[k] for k in keys.tolist()]


def test_vocabularies_that_do_not_fit():
    with pytest.raises(ValueError):
        alignment.Layout(1 << 24, 1 << 24)


def test_empty_and_clashing(spark):
    assert alignment.align(docs_of(spark, []))[0].count() == 0
    texts = mixed(4, 20)
    wide = docs_of(spark, texts).selectExpr("*", "1 as chunk", "2 as local", "3 as part", "4 as pairs", "5 as docs", "6 as n_a", "7 as salt")
    assert made(alignment.align(wide)[0]) == brute(texts)
    assert made(alignment.align(docs_of(spark, [None, ""]))[0]) == brute([None, ""])


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \r\n"])
def test_long_blanks_encode_as_the_tokenizer_does(spark, blank):
    text = "a" + blank * (2_000_000 // len(blank)) + "b"
    assert tokens.encode(text, A).tolist() == brute_ids(text)
    assert tokens.lengths([text, "x"], A) == [len(brute_ids(text)), 1]


def test_long_blanks_do_not_end_the_job(spark):
    texts = ["a" + " " * 1_000_000 + "b", "<|endoftext|>" + "\n" * 1_000_000 + "b", "plain"]
    docs = docs_of(spark, texts)
    assert token_counts.length_histogram(docs).agg({"n_docs": "sum"}).first()[0] == 3
    pieces = packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in pieces} == {i: len(brute_ids(t)) + 1 for i, t in enumerate(texts)}
    assert sum(r.n_a > 0 for r in alignment.align(docs)[0].collect()) == 3


def test_long_texts(spark):
    texts = ["".join(mixed(5, 3_000)), "漢" * 300_000, "a" * 200_000]
    per_doc = {r.doc_id: r for r in alignment.align(docs_of(spark, texts))[0].collect()}
    assert all(per_doc[i].n_links == per_doc[i].n_a + per_doc[i].n_b - per_doc[i].n_groups and per_doc[i].n_a for i in range(3) if i)


def test_registered(spark):
    assert queries.op12_tokenizer_alignment(spark, "/root/testdata/sf0.001").count() == 200
