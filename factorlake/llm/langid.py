"""Language ID: rank-order n-gram profiles and out-of-place distance.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, words padded with a blank),
most frequent first. A document's own list is compared with each: for every n-gram the difference of its two ranks,
or the profile's length if the profile lacks it. The nearest language wins. N-grams are counted over the whole
of every training text, pre-aggregated for each chunk, and over the whole of every document to predict.

Letters are taken case-folded, as UTF-16 units, so an n-gram and the row it belongs to fit in 64 bits and a chunk
is counted by one sort. A chunk is about PIECE characters; a longer text is cut into pieces of that length, which leaves its counts as they
are (see ``cut_text``), blanks or not, so memory beyond the text itself does not grow with it. What is a letter is decided by code point: both halves of one beyond 16 bits count, those of an emoji don't.

``keep_identified`` rejects by the distance. It learns from all labelled documents, scores them too, and asks of a document
LEAST_SHARE of the median score that labelled documents of its nearest language have where that language is also
their label, and more than 0 in any case, so texts in a script that no profile has go.

Defined cases: null text and text without letters give ``und`` and score 0; ties go to the smaller n-gram and to the
first language by name; without any labelled text every document is ``und``, and ``keep_identified``, which then has nothing
to compare with, rejects texts without letters only; repeated rows are predicted one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEP, GRAM_BITS = np.uint64(0x20), np.uint64(48)
UNKNOWN = "und"
#: Fixed value: in sf0.1 labelled documents have 0.55 of the median score of their language or more, random letters 0.30 or less.
LEAST_SHARE = 0.4
SCORE_BINS = 1_000
#: Characters whose n-grams are listed at once, about 60 MB of arrays.
PIECE = 250_000


@lru_cache(maxsize=1)
def letter_units() -> np.ndarray:
    """Whether a UTF-16 unit is a letter by itself; halves of code points beyond 16 bits are not."""
    return np.array([chr(c).isalpha() for c in range(65_536)])


def letters_of(flat: np.ndarray) -> np.ndarray:
    """Whether each UTF-16 unit is a letter, or half of one."""
    letter = letter_units()[flat]
    high = np.flatnonzero((flat[:-1] & 0xFC00) == 0xD800)
    high = high[(flat[high + 1] & 0xFC00) == 0xDC00]
    if len(high):
        points, of = np.unique(0x10000 + ((flat[high].astype(np.int64) & 0x3FF) << 10) + (flat[high + 1] & 0x3FF), return_inverse=True)
        high = high[np.array([chr(c).isalpha() for c in points])[of]]
        letter[high] = letter[high + 1] = True
    return letter


def cut_text(text: str) -> list[tuple[str, int]]:
    """Lower-cased pieces of about PIECE characters and their signs, so that the signed counts of the pieces sum up to the text's.

    A cut before a character that is no letter parts no n-gram. Within a word both sides get the two letters before the cut, and a
    piece of these two alone counts negatively: what all three have, blanks at the cut included, is counted once.
    """
    text, parts, at = text.lower(), [], 0
    piece = max(PIECE, 3)
    while len(text) - at > piece:
        end = at + piece
        while end < len(text) and text[end].isalpha() and not (text[end - 1].isalpha() and text[end - 2].isalpha()):
            end += 1
        if end == len(text):
            break
        parts.append((text[at:end], 1))
        at = end
        if text[end].isalpha():
            parts.append((text[end - 2 : end], -1))
            at = end - 2
    return [*parts, (text[at:], 1)]


def gram_counts(texts: list[str], longest: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of all n-grams of the texts, by row and gram; at most 65,536 texts."""
    if sum(map(len, texts)) <= 2 * PIECE:
        return piece_counts(list(range(len(texts))), texts, longest)
    keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    pieces = ((i, part, sign) for i, text in enumerate(texts) for part, sign in cut_text(text))
    waiting: dict[int, tuple[list[int], list[str]]] = {1: ([], []), -1: ([], [])}
    size, piece = 0, next(pieces, None)
    while piece:
        (i, part, sign), piece = piece, next(pieces, None)
        waiting[sign][0].append(i)
        waiting[sign][1].append(part)
        size += len(part)
        if size >= PIECE or piece is None:
            made = [(s, *piece_counts(*own, longest)) for s, own in waiting.items() if own[0]]
            keys, inverse = np.unique(np.concatenate([keys, *[(row << GRAM_BITS) | gram for _, row, gram, _ in made]]), return_inverse=True)
            weights = np.concatenate([counts, *[s * count.astype(np.int64) for s, _, _, count in made]])
            counts = np.bincount(inverse, weights=weights, minlength=len(keys)).astype(np.int64)
            waiting, size = {1: ([], []), -1: ([], [])}, 0
    keys, counts = keys[counts > 0], counts[counts > 0]
    return keys >> GRAM_BITS, keys & np.uint64((1 << 48) - 1), counts.astype(np.uint64)


def piece_counts(rows: list[int], texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram_counts of texts that belong to the rows given, in one sort."""
    units = [np.frombuffer(f" {t.lower()} ".encode("utf-16-le", "surrogatepass"), dtype=np.uint16) for t in texts]
    row = np.repeat(np.array(rows, dtype=np.uint64), [len(u) for u in units])
    flat = np.concatenate(units)
    letter = letters_of(flat)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank after each word, and one before the first
    keep[:-1] |= letter[1:]
    flat, letter, row = np.where(letter, flat, 32)[keep].astype(np.uint64), letter[keep], row[keep]
    if not len(flat):
        return (np.zeros(0, dtype=np.uint64),) * 3
    base, made, inside, code = row << GRAM_BITS, [], np.ones(len(flat), dtype=bool), np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, longest + 1):  # code[i]: the n units from i on
        code = (code[: len(flat) - n + 1] << np.uint64(16)) | flat[n - 1 :]
        size = len(code)
        if n >= 3:  # no blank within
            inside = inside[:size] & letter[n - 2 : n - 2 + size]
        whole = row[:size] == row[n - 1 :]
        whole &= inside[:size] if n >= 3 else letter[:size] | letter[n - 1 :]
        made.append(base[:size][whole] | code[whole])
    grams = np.sort(np.concatenate(made))
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first] >> GRAM_BITS, grams[first] & np.uint64((1 << 48) - 1), np.diff(np.append(first, len(grams))).astype(np.uint64)


def top_grams(row: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank) of each row's most frequent n-grams."""
    order = np.argsort((row << np.uint64(40)) | (np.uint64((1 << 40) - 1) - count), kind="stable")
    row, gram = row[order], gram[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    return row[rank < top], gram[rank < top], rank[rank < top]


def learn_profiles(docs: DataFrame, top: int = 300, lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank): profiles learned from the whole texts of docs(text, lang) with a language."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, texts in common.text_chunks(batch.column("text"), PIECE):
                row, gram, count = gram_counts(texts)
                names = sorted(set(langs[lo:hi]))
                of = np.array([names.index(x) for x in langs[lo:hi]], dtype=np.uint64)
                pairs, inverse = np.unique((of[row.astype(np.int64)] << GRAM_BITS) | gram, return_inverse=True)
                sums = np.bincount(inverse, weights=count, minlength=len(pairs)).astype(np.int64)
                held, grams = (pairs >> GRAM_BITS).tolist(), (pairs & np.uint64((1 << 48) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in held], pa.string()), pa.array(grams), pa.array(sums)], ["lang", "gram", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language's n-grams are ranked in parts first, so none is sorted in one task
    by = [F.desc("n"), F.asc("gram")]
    parts = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)) - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


def nearest(texts: list[str], tables: list[tuple], top: int) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score; tables: (language, sorted n-grams, their ranks)."""
    row, gram, rank = top_grams(*gram_counts(texts), top)
    row = row.astype(np.int64)
    held = np.bincount(row, minlength=len(texts))
    far = np.full((max(len(tables), 1), len(texts)), np.inf)
    for i, (_, grams, ranks) in enumerate(tables):
        at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        far[i] = np.bincount(row, weights=np.where(grams[at] == gram, np.abs(ranks[at] - rank), top), minlength=len(texts))
    best = far.argmin(axis=0)
    some = (held > 0) & (len(tables) > 0)
    score = np.where(some, 1 - np.where(some, far[best, np.arange(len(texts))], 0) / np.maximum(held * top, 1), 0.0)
    return [tables[b][0] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.clip(score, 0, 1)


def profile_tables(profiles: DataFrame):
    """The profiles, sent to the tasks whole: they have ``top`` rows for each of a fixed vocabulary of languages."""
    known: dict[str, dict[int, int]] = {}
    for row in profiles.toArrow().to_pylist():
        known.setdefault(row["lang"], {})[row["gram"]] = row["rank"]
    tables = []
    for name in sorted(known):
        grams = sorted(known[name])
        tables.append((name, np.array(grams, dtype=np.uint64), np.array([known[name][g] for g in grams], dtype=np.int64)))
    return profiles.sparkSession.sparkContext.broadcast(tables)


def predict(docs: DataFrame, profiles: DataFrame, top: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, lang_pred, score).

    score is 1 minus the distance to the nearest profile as a share of the largest possible one.
    """
    tables = profile_tables(profiles)

    def work(ids: list, texts: list[str]) -> dict:
        langs, scores = nearest(texts, tables.value, top)
        return {"doc_id": ids, "lang_pred": langs, "score": scores}

    return common.map_texts(common.text_rows(docs, id_col, text_col), work, "doc_id long, lang_pred string, score double", chars=PIECE)


def held_out(id_col: Column | str = "doc_id") -> Column:
    return common.crc_mod(id_col, 4) == 2


def identify(docs: DataFrame, top: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that are not held out."""
    profiles = learn_profiles(docs.where(~held_out()), top)
    return predict(docs, profiles, top).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def least_scores(docs: DataFrame, tables, top: int = 300) -> dict[str, float]:
    """For each language LEAST_SHARE of the median score of the documents that have it both as label and as nearest profile."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            labels = batch.column("lang").to_pylist()
            for lo, hi, texts in common.text_chunks(batch.column("text"), PIECE):
                counts: dict[tuple[str, int], int] = {}
                for label, lang, score in zip(labels[lo:hi], *nearest(texts, tables.value, top), strict=True):
                    if label == lang:
                        key = lang, int(score * SCORE_BINS)
                        counts[key] = counts.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in counts], pa.string()), pa.array([x for _, x in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["lang", "bin", "n"])

    rows = docs.where("lang is not null").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    held: dict[str, list] = {}
    for row in rows.mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # at most SCORE_BINS + 1 rows a language
        held.setdefault(row["lang"], []).append((row["bin"], row["n"]))
    least = {}
    for lang, pairs in held.items():
        bins, n = np.array(sorted(pairs)).T
        least[lang] = LEAST_SHARE * float(bins[np.searchsorted(np.cumsum(n), n.sum() / 2)]) / SCORE_BINS
    return least


def keep_identified(docs: DataFrame, least: float | None = None, top: int = 300) -> DataFrame:
    """docs without those that no language is near enough to; decided where a row is read.

    A score must be above 0 and at least ``least``; None: the least score of the nearest language, by ``least_scores``.
    """
    import pyarrow as pa

    tables, at = profile_tables(learn_profiles(docs, top)), docs.columns.index("text")
    by_lang = least_scores(docs, tables, top) if least is None and tables.value else {}
    other = min(by_lang.values(), default=0.0) if least is None else least  # a language that is nearest to none of its own documents

    def keeps(texts: list[str]) -> list[bool]:
        if not tables.value:
            return (np.bincount(gram_counts(texts, 1)[0].astype(np.int64), minlength=len(texts)) > 0).tolist()
        return [lang != UNKNOWN and score > 0 and score >= by_lang.get(lang, other) for lang, score in zip(*nearest(texts, tables.value, top), strict=True)]

    def run(batches):
        for batch in batches:
            keep = []
            for _, _, texts in common.text_chunks(batch.column(at).fill_null(""), PIECE):
                keep += keeps(texts)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
