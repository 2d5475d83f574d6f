"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length.

Folding lower-cases, maps homoglyphs, full-width letters and digit or symbol substitutions to the letters they stand for, and leaves words of
letters alone; a ``1`` is tried as an i and as an l. The lexicon is learned from labelled documents: whole words and word beginnings whose
weight, the logarithm of their share of toxic documents over that of the others, is at least LEAST_WEIGHT, and whose documents are toxic
so often that chance would bring less than CHANCE such terms among all the sample's terms (a bound of the binomial tail), so
the support asked for grows with the logarithm of the vocabulary only. A pair of words with a lexicon term that clean documents use at least
as often as toxic ones is an exception: it is matched as a longer pattern of weight 0. A document's weights are summed and divided by its
length; a logistic curve of that density makes the score.

A text is split into words only if its letters, as they stand, hold a lexicon term, or if it has something to fold: any other has no match.

Labels are learned from a bounded sample: at most SAMPLE labelled documents of each label, those whose ids hash lowest; its words bound the
lexicon and the exceptions, of which none are dropped. Scoring covers every whole text.

Defined cases: a null or empty text scores as a document without matches; without labels of both kinds the lexicon
is empty and every score is 0; of repeated doc_ids in labels the largest label counts; repeated documents are scored one by one; a null
doc_id has no label and a null ``held_out``; of terms at the same place the longest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 10_000
LEAST_WEIGHT, CHANCE = 2.0, 0.05
#: Look-alike letters, and digits and symbols used for letters.
HOMOGLYPHS = {"а": "a", "ɑ": "a", "α": "a", "в": "b", "ϲ": "c", "с": "c", "ԁ": "d", "е": "e", "ҽ": "e", "ɡ": "g", "һ": "h", "і": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "ο": "o", "р": "p", "ρ": "p", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ѵ": "v", "ν": "v", "ԝ": "w", "х": "x", "χ": "x", "у": "y", "γ": "y"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
WIDE = {chr(0xFF21 + i): chr(ord("a") + i) for i in range(26)} | {chr(0xFF41 + i): chr(ord("a") + i) for i in range(26)}
FOLD = str.maketrans(HOMOGLYPHS | WIDE | SUBSTITUTES)
FOLD_LETTERS = str.maketrans(HOMOGLYPHS | WIDE)
MIXED = re.compile(r"[0134578@$]+[^\W\d_]+(?:[0134578@$!]+[^\W\d_]+)*|[^\W\d_]+(?:[0134578@$!]+[^\W\d_]+)+")
WORD = re.compile(r"[^\W\d_]+")
#: What a text must hold if folding changes it: a look-alike letter, or a digit or symbol before a letter.
FOLDABLE = rf"[{''.join(HOMOGLYPHS)}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}]|[0134578@$!][\pL\p{{Nl}}\p{{No}}]"


def folded_words(text: str) -> list[str]:
    """Words of a folded text; digits and symbols are letters only next to letters, so numbers and punctuation aren't words.

    Words in which a 1 is an i come in their place, those in which it is an l once more at the end.
    """
    text, other = text.lower(), []
    if not text.isascii():
        text = text.translate(FOLD_LETTERS)

    def fold(m: re.Match) -> str:
        if "1" in m[0]:
            other.append(m[0].replace("1", "l").translate(FOLD))
        return m[0].translate(FOLD)

    return WORD.findall(MIXED.sub(fold, text)) + other


def terms_of(words: list[str]) -> set[str]:
    """Whole words ("= word") and beginnings of 4 to 6 letters ("^ word")."""
    words = set(words)
    return {f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in (4, 5, 6) if len(w) >= n}


def held_out(id_col: Column | str = "doc_id") -> Column:
    return common.crc_mod(id_col, 5) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``bound`` documents of each label, none held out; of rows that repeat a doc_id the one whose text has the smallest hash."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for y in (0, 1)]
    ids = common.cut(parts[0].unionByName(parts[1]))  # at most 2 * bound rows of two numbers, so broadcast is safe
    found = common.text_rows(docs).join(F.broadcast(ids), "doc_id")
    return common.cut(found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")))


def counted(sample: DataFrame, features) -> DataFrame:
    """(term, toxic_docs, clean_docs) of the features of each sampled text, pre-aggregated by chunk."""
    rows = sample.select((F.col("toxic") > 0).cast("long").alias("doc_id"), "text")  # the label stands in for the id

    def work(ids: list, texts: list[str]) -> dict:
        counts = [Counter(), Counter()]
        for label, text in zip(ids, texts, strict=True):
            counts[label].update(features(text))
        terms = sorted(counts[0].keys() | counts[1].keys())
        return {"term": terms, "toxic_docs": [counts[1][t] for t in terms], "clean_docs": [counts[0][t] for t in terms]}

    return common.map_texts(rows, work, "term string, toxic_docs long, clean_docs long").groupBy("term").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms and their weights."""
    sample = sample.dropDuplicates(["text", "toxic"])  # copies are no evidence of their own
    totals = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return {}
    terms = common.cut(counted(sample, lambda text: terms_of(folded_words(text))))
    bound, toxic_share = log(max(terms.count(), 1) / CHANCE), totals[True] / (totals[True] + totals[False])
    a, b = F.col("toxic_docs"), F.col("clean_docs")
    weight = F.log((a + 0.5) / (totals[True] + 1)) - F.log((b + 0.5) / (totals[False] + 1))
    part = lambda k, p: F.when(k > 0, k * F.log(k / (a + b) / p)).otherwise(0.0)
    sure = terms.withColumn("weight", weight).where((F.col("weight") >= LEAST_WEIGHT) & (part(a, toxic_share) + part(b, 1 - toxic_share) >= bound))
    return {r["term"]: r["weight"] for r in sure.collect()}  # bounded by the words of the sample


def pattern_of(term: str) -> str:
    return f" {term[1:]} " if term[0] == "=" else f" {term[1:]}"


def build(lexicon: dict[str, float], exceptions: list[str]):
    """The automaton: patterns of the lexicon and, of weight 0, of exception phrases."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        automaton.add_word(pattern_of(term), weight)
    for phrase in exceptions:
        automaton.add_word(" " + "  ".join(phrase.split(" ")) + " ", 0.0)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def haystack(words: list[str]) -> str:
    """Each word with a blank of its own on both sides, so matches of neighbours don't compete for one."""
    return f" {'  '.join(words)} "


def matcher(lexicon: dict[str, float], exceptions: list[str]):
    """density(texts): for each text log(1 + 100 * matched weight / (words + 50))."""
    import ahocorasick
    import pyarrow as pa
    import pyarrow.compute as pc

    automaton, bare = build(lexicon, exceptions), ahocorasick.Automaton()
    for term in lexicon:
        bare.add_word(term[1:], 1)
    if len(bare):
        bare.make_automaton()

    def density(text: str, foldable: bool) -> float:
        if not lexicon or (not foldable and next(bare.iter(text.lower()), None) is None):
            return 0.0
        words = folded_words(text)
        return log(1 + 100 * sum(w for _, w in automaton.iter_long(haystack(words))) / (len(words) + 50))

    def all_densities(texts: list[str]) -> list[float]:
        return [density(t, f) for t, f in zip(texts, pc.match_substring_regex(pa.array(texts, pa.string()), FOLDABLE).to_pylist(), strict=True)]

    return all_densities


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float], least_docs: int = 3) -> list[str]:
    """Pairs of words with a lexicon term of which clean sampled documents have at least as many as toxic ones, and ``least_docs`` in any case: fewer are chance."""
    whole, starts = {t[1:] for t in lexicon if t[0] == "="}, {t[1:] for t in lexicon if t[0] == "^"}

    def pairs(text: str) -> set[str]:
        words = folded_words(text)
        hit = [w in whole or any(w[:n] in starts for n in (4, 5, 6)) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:], strict=False) if x or y}

    found = counted(sample, pairs).where((F.col("clean_docs") >= least_docs) & (F.col("clean_docs") >= F.col("toxic_docs")))
    return sorted(r["term"] for r in found.select("term").collect())  # bounded by the words of the sample


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; both labels weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * len(y) * np.array([0, *[1] * (len(beta) - 1)]) * beta * 0.01
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * len(y) * 0.01 * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[dict[str, float], list[str], np.ndarray]:
    """(lexicon, exceptions, curve)."""
    sample = labelled_sample(docs, labels, bound)
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return {}, [], np.array([-30.0, 0.0])
    exceptions = learn_exceptions(sample, lexicon)

    def work(ids: list, texts: list[str]) -> dict:
        return {"y": ids, "x": matcher(lexicon, exceptions)(texts)}

    rows = common.map_texts(sample.select((F.col("toxic") > 0).cast("long").alias("doc_id"), "text"), work, "y long, x double").toArrow()  # bounded by the sample
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    order = np.lexsort([x, y])  # the same sums in any order of arrival
    return lexicon, exceptions, fit_curve(x[order, None], y[order].astype(float))


def score(docs: DataFrame, lexicon: dict[str, float], exceptions: list[str], curve: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, score)."""
    held: list = []

    def work(ids: list, texts: list[str]) -> dict:
        if not held:
            held.append(matcher(lexicon, exceptions))
        return {"doc_id": ids, "score": 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * np.array(held[0](texts)), -30, 30)))}

    return common.map_texts(common.text_rows(docs, id_col, text_col), work, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), learned from labels that are not held out."""
    scored = score(docs, *learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
