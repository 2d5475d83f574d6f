"""Source divergence against brute force over every (group, term) cell, and the tree against all pairs of items."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_text_operators import DOCS

from factorlake.llm import divergence


def brute(rows, top=200):
    """rows: (lang, source, text)."""
    fold = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    docs = [(a or "", b or "", [fold(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for a, b, t in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        groups = {s: c for (a, s), c in counts.items() if a == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            order = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(sorted(terms, key=order)[:top])]
    return sorted(out)


def made(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, a, b, None) for i, (a, b, t) in enumerate(rows)], DOCS)


def corpus(seed, docs, sources=6):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "zu", "Éa", "漢") for b in ("x", "Y", "ß", "é", "qq")]
    return [(r.choice(["en", "de", None]), r.choice([f"s{i}" for i in range(sources)] + [None]), " 1-".join(r.choices(words, weights=range(1, 21), k=r.randint(0, 30)))) for _ in range(docs)]


def test_divergence_matches_brute_force(spark):
    rows = [*corpus(1, 150), ("en", "none", None), ("en", "none", "123 !!"), ("lone", "one", "a a a"), ("lone", "two", ""), ("single", "s", "b c"), ("single", "s", "b c"), ("single", "s", "b c")]
    rows += [rows[0]] * 3 + [("en", "s1", "long " * 50_000 + "x" * 100_000)] * 3
    assert made(divergence.divergence(docs_of(spark, rows))) == brute(rows)


def test_top_is_of_terms_alone(spark):
    rows = corpus(2, 120)
    assert made(divergence.divergence(docs_of(spark, rows), top=2)) == brute(rows, top=2)


def test_counters_are_sent_on_and_chunks_of_the_tree_add_up(spark, monkeypatch):
    rows = corpus(3, 80)
    before = made(divergence.divergence(docs_of(spark, rows)))
    assert before == brute(rows)
    counted = divergence.term_counts(docs_of(spark, rows).coalesce(1)).groupBy("lang", "source", "term").sum("n", "docs").collect()
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    assert sorted(divergence.term_counts(docs_of(spark, rows).coalesce(1)).groupBy("lang", "source", "term").sum("n", "docs").collect()) == sorted(counted)
    monkeypatch.setattr(divergence, "CELLS", 6)
    assert made(divergence.divergence(docs_of(spark, rows))) == before


@pytest.mark.parametrize("seed", range(4))
def test_tree_equals_all_pairs_of_items(seed):
    r = random.Random(seed)
    paths = Counter(tuple((s, r.randint(1, 2)) for s in range(6) if r.random() < 0.5) for _ in range(200))
    rows = sorted((p, k) for p, k in paths.items() if p)
    p_of, p0 = lambda s, n: 100 * n + 7 * s + 3, lambda s: 11 + 5 * s
    expected = Counter()
    for path, k in rows:
        for s, a in path:
            for o, b in path:
                if s != o:
                    x, y, f = p_of(s, a), p_of(o, b), lambda p, q: (p - q) ** 2 // q
                    expected[s, o] += k * (f(x, y) - f(x, p0(o)) - f(p0(s), y) + f(p0(s), p0(o)))
    flat = [(s, n, p_of(s, n), p0(s)) for path, _ in rows for s, n in path]
    got = divergence.tree_corrections(np.array([len(p) for p, _ in rows]), *[np.array(x) for x in zip(*flat, strict=True)], np.array([k for _, k in rows]))
    assert {(a, b): c for a, b, c in zip(*map(np.ndarray.tolist, got), strict=True)} == dict(expected)


def test_large_counts_stay_exact(spark):
    df = spark.sql("select 9000000000000000000L as n, 9100000000000000000L as total, 1000L as terms")
    assert df.select(divergence.share("n", "total", "terms").alias("p")).first().p == 1 + 10**9 * (9 * 10**18 + 1) // (91 * 10**17 + 1000)


def test_empty_and_clashing(spark):
    assert divergence.divergence(docs_of(spark, [])).count() == 0
    rows = corpus(4, 40)
    wide = docs_of(spark, rows).selectExpr("*", "1 as n", "2 as term", "3 as p", "4 as rank", "5 as value", "6 as docs", "7 as total")
    assert made(divergence.divergence(wide)) == brute(rows)
