"""The language model: base against brute force, attention against a loop over single ids, gradients, proper probabilities, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_text_operators import DOCS, prose

from factorlake.llm import attention_lm as lm
from factorlake.llm import queries, tokens

VOCABULARY = tokens.default_vocabulary()
SMALL = lm.Shape(context=6, stride=4, width=8, heads=2, classes=5, own_rows=20)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def fold(i):
    return zlib.crc32(str(i).encode()) % 7


def brute_base(rows):
    words = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + [None]
    counts = Counter(w for i, t in rows if i is not None and fold(i) != 2 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows}


def toy(shape=SMALL, size=40, seed=1):
    r = np.random.default_rng(seed)
    counts = np.floor(r.exponential(20, size)) * (np.arange(size) < 35)
    classes = lm.Classes(counts, np.arange(size) % 2 == 0, shape)
    classes.regroup(r.integers(0, 9, (len(classes.frequent), 2 * shape.classes)).astype(float))
    follow = np.log(r.dirichlet(np.ones(shape.classes), shape.classes))
    params = {k: (r.standard_normal(x.shape) * 0.5).astype(np.float32) for k, x in lm.start(shape).items()}
    return classes, follow, params, lm.Model(shape, follow, params)


def by_loop(model, classes, ids, end):
    """log10 of a text's probability, one id after the other."""
    p, s, total = model.p, model.shape, 0.0
    for i, target in enumerate(ids):
        begin = i // s.stride * s.stride - (s.context - s.stride)  # the window's first input follows this many ids
        line = [end if j < 0 else ids[j] for j in range(begin - 1, i)]
        x = p["embed"][classes.row[line]].astype(np.float64)
        q, k, v, d = x[-1] @ p["query"], x @ p["key"], x @ p["value"], s.width // s.heads
        mixed = []
        for h in range(s.heads):
            a = np.exp(k[:, h * d : h * d + d] @ q[h * d : h * d + d] / math.sqrt(d) + np.array([p["distance"][h, len(line) - 1 - j] for j in range(len(line))]))
            mixed.append(a / a.sum() @ v[:, h * d : h * d + d])
        hidden = x[-1] @ p["own"] + np.concatenate(mixed) @ p["mix"] + p["shift"]
        hidden = hidden / np.sqrt(1 + hidden**2)
        logits = hidden @ p["out"].T + p["bias"] + model.prior[classes.of[line[-1]]]
        total += logits[classes.of[target]] - np.log(np.exp(logits).sum()) + classes.log_within[target]
    return total / math.log(10)


def test_windows_score_each_id_once_as_a_loop_does():
    classes, _, _, model = toy()
    r = np.random.default_rng(2)
    texts = [np.append(r.integers(0, 39, n), 39) for n in (0, 1, 3, 4, 5, 17, 200)]
    got = lm.log10_probabilities(model, classes, texts, 39)
    assert np.allclose(got, [by_loop(model, classes, t.tolist(), 39) for t in texts], rtol=1e-5)


def test_probabilities_sum_to_one():
    classes, _, _, model = toy()
    shares = model.forward(*lm.Windows([np.array([3, 5, 7, 39])], classes, SMALL, 39).batch(slice(None))[:3])
    of_class = shares["shares"] / shares["total"]
    assert np.allclose(of_class[:, classes.of] @ np.exp(classes.log_within), 1, rtol=1e-5) or np.allclose((of_class[:, classes.of] * np.exp(classes.log_within)).sum(axis=1), 1, rtol=1e-5)


def test_gradient_equals_differences():
    classes, follow, params, _ = toy(seed=3)
    w = lm.Windows([np.append(np.random.default_rng(4).integers(0, 39, 21), 39)], classes, SMALL, 39)
    exact = {k: x.astype(np.float64) for k, x in params.items()}
    rows, last, target, used = w.batch(slice(None))
    loss = lambda p: -float((lm.Model(SMALL, follow, p).log_class(rows, last, target).reshape(used.shape) * used).sum() / used.sum())
    grads = lm.Model(SMALL, follow, exact).gradient(rows, last, target, used)
    touched, values = grads.pop("embed")
    whole = np.zeros(params["embed"].shape)
    whole[touched] = values
    r = np.random.default_rng(5)
    for name, g in {**grads, "embed": whole}.items():
        for at in [tuple(r.integers(0, n) for n in g.shape) for _ in range(6)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            more, less = ({k: x.copy() for k, x in exact.items()} for _ in range(2))
            more[name][at] += 1e-4
            less[name][at] -= 1e-4
            assert abs((loss(more) - loss(less)) / 2e-4 - g[at]) < 2e-4 + 2e-3 * abs(g[at]), name


def test_sampled_windows_are_those_of_the_text():
    classes, _, _, _ = toy()
    for n in (0, 1, 3, 4, 7, 8, 50):
        ids = np.random.default_rng(n).integers(0, 39, n)
        w = lm.Windows([np.append(ids, 39)], classes, SMALL, 39)
        rows, last, target, used = w.batch(slice(None))
        seen = [lm.sampled_windows(ids, row, SMALL, 39, 3) for row in range(3)]
        assert sum(map(len, seen)) == len(w)
        for row, made in enumerate(seen):
            at = [j for j in range(len(w)) if (j + row) % 3 == 0]
            assert np.array_equal(classes.row[made[:, :-1]], rows[at]) and np.array_equal(classes.of[made[:, -SMALL.stride :]], target[at])
            assert np.array_equal(classes.of[made[:, -SMALL.stride - 1 : -1]], last[at])
            is_end = made[:, -SMALL.stride :] == 39
            assert np.array_equal(np.cumsum(is_end, axis=1) - is_end == 0, used[at])


def test_flatten_round_trip():
    params = lm.start(SMALL)
    again = lm.unflatten(lm.flatten(params), params)
    assert all(np.array_equal(params[k], again[k]) for k in params)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    made = [(i, prose(i, r.randint(1, 120)).capitalize()) for i in range(150)]
    return [*made, (200, None), (201, ""), (202, " \t\n"), (203, "Ab aB\x0bAB ab É é <|endoftext|>"), (204, "x" * 70 + " " + "x" * 70), (205, " ".join(["Same"] * 3000)), (206, "漢字" * 40_000)]


def test_base_matches_brute_force(spark, rows, monkeypatch):
    expected = brute_base(rows)
    for hot in (lm.HOT_WORDS, 3):
        monkeypatch.setattr(lm, "HOT_WORDS", hot)
        made = {r.doc_id: r for r in lm.score(docs_of(spark, rows), rounds=1).collect()}
        assert len(made) == len(rows)
        for i, (n, known, total, base) in expected.items():
            r = made[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 2, n, known, total)
            assert abs(r.base_score - base) < 1e-6 * abs(base)
            assert r.score < 0 and math.isfinite(r.score)


def test_defined_cases(spark, rows, monkeypatch):
    assert lm.score(docs_of(spark, [])).count() == 0
    held = [i for i in range(100) if fold(i) == 2][:3]
    nothing = lm.score(docs_of(spark, [(i, "only held out", ) for i in held])).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == 0 and abs(r.score + math.log10(50257) * (len(tokens.encode("only held out", VOCABULARY)) + 1)) < 0.05 * abs(r.score) for r in nothing)
    wide = docs_of(spark, [*rows[:20], (None, rows[0][1]), rows[0]]).selectExpr("*", "1 as row", "2 as ids", "3 as word", "4 as c", "5 as held_out", "6 as score")
    made = lm.score(wide).collect()
    assert len(made) == 22 and [r.held_out for r in made if r.doc_id is None] == [None]
    twice = [r for r in made if r.doc_id == rows[0][0]]
    assert len(twice) == 2 and twice[0].score == twice[1].score


def test_training_helps_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = lambda df: df.where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    untrained, some, all_windows = (total(lm.score(docs, **how))["sum(score)"] for how in ({"rounds": 0}, {}, {"every": 1}))
    assert untrained < some < all_windows and all_windows > untrained * 0.98
    r = random.Random(3)
    texts = [x.text for x in docs.where("text is not null").limit(40).collect()]
    shuffled = [(i, " ".join(r.sample(t.split(" "), len(t.split(" "))))) for i, t in enumerate(texts)]
    noise = [(100 + i, "".join(r.sample(t, len(t)))) for i, t in enumerate(texts)]
    both = {x.doc_id: x for x in lm.score(docs_of(spark, [*enumerate(texts, 1000), *shuffled, *noise])).collect()}
    assert sum(both[1000 + i].score > both[100 + i].score for i in range(40)) >= 38


def test_registered(spark):
    assert queries.op11_lm_score(spark, "/root/testdata/sf0.001").count() == 200
