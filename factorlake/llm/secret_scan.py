"""Secret scans: fixed rules, and two character Markov models compared by log-likelihood ratio.

The rules (assignments, access keys, long hexadecimal strings) label the samples: what they match is a sample of random
strings, all other text is a sample of ordinary identifiers, but for runs of UNLABELLED or more token characters with letters and digits,
which may be secrets that no rule knows and belong to neither. A pass over all texts counts character
transitions of both kinds in Spark (a fixed number of rows for each chunk); the models are two tables of 68 x 68
log-probabilities. A second pass scores every run of token characters, of any length and alphabet: a run whose
log-likelihood ratio outweighs a prior of one secret in a million tokens is a span of kind ``random``.
Rule spans always stay; model spans that overlap one are left out.

Defined cases: null and empty texts have no spans; without any rule match in the corpus the random model is uniform;
repeated rows are scanned one by one; ids, null or repeated, are only carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "random")


def either_case(words: str) -> str:
    """ASCII letters in either case; re.IGNORECASE would also match some other letters."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


ASSIGN = re.compile(rf"(?:{either_case('password|passwd|secret|token|api_?key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: Length from which a run of letters and digits is left out of the ordinary sample.
UNLABELLED = 16
TOKEN = re.compile(f"[A-Za-z0-9+/_=-]{{{UNLABELLED},}}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
N = len(SYMBOLS) + 1  # 0: any other character
CLASS = np.zeros(256, dtype=np.int64)
CLASS[[ord(c) for c in SYMBOLS]] = np.arange(1, N)
IN_TOKEN = CLASS > 0
IN_TOKEN[ord(".")] = False
PRIOR = 1e-6
#: Pseudo-counts of a row of the models.
BACKOFF = 20


def rule_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, secret): leftmost matches of each rule, those too short dropped."""
    out = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def worth_a_scan(texts: list[str]) -> tuple[list[bool], list[bool]]:
    """Whether a text can have rule matches, and digits, by linear-time matching without Python."""
    column = pa.array(texts, pa.string())
    rules = pc.match_substring_regex(column, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    return rules.to_pylist(), pc.match_substring_regex(column, "[0-9]").to_pylist()


def transitions(text: str) -> np.ndarray:
    """Pairs of symbols, as first * N + second, of which at least one is a token character."""
    classes = CLASS[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]
    pairs = classes[:-1] * N + classes[1:]
    return pairs[pairs > 0]


def unlabelled(text: str, taken: list[tuple]) -> Iterator[re.Match]:
    """Long runs of token characters with a letter and a digit that touch no span already found (start, kind's place, end, ...)."""
    for m in TOKEN.finditer(text):
        token, (a, b) = m[0], m.span()
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and not any(s[0] < b and a < s[2] for s in taken):
            yield m


def train(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the next symbol (random strings, ordinary identifiers), counted over all texts."""

    def work(ids: list, texts: list[str]) -> dict:
        counts = np.zeros((2, N * N), dtype=np.int64)
        for text, rules, digits in zip(texts, *worth_a_scan(texts), strict=True):
            spans = rule_spans(text) if rules else []
            for secret in {s for *_, s in spans}:
                pairs = np.bincount(transitions(secret), minlength=N * N)
                counts[0] += pairs
                counts[1] -= pairs
            for m in unlabelled(text, spans) if digits else ():
                counts[1] -= np.bincount(transitions(m[0]), minlength=N * N)
        counts[1] += np.bincount(transitions("\n".join(["", *texts, ""])), minlength=N * N)
        label, pair = np.nonzero(counts)
        return {"label": label, "pair": pair, "n": counts[label, pair]}

    counts = np.zeros((2, N * N))
    for row in common.map_texts(docs, work, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # at most 2 * N * N rows
        counts[row["label"], row["pair"]] += max(row["n"], 0)
    return log_probabilities(counts.reshape(2, N, N))


def log_probabilities(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transitions backed off to single symbols. Half of the random model is uniform, as labelled strings don't use every alphabet,
    and a fiftieth of the ordinary one, so a symbol that the corpus lacks (an underscore) isn't proof of a secret."""
    single = (counts.sum(axis=1, keepdims=True) + 1) / (counts.sum(axis=(1, 2), keepdims=True) + N)
    p = (counts + BACKOFF * single) / (counts.sum(axis=2, keepdims=True) + BACKOFF)
    return np.log(0.5 * p[0] + 0.5 / N), np.log(0.98 * p[1] + 0.02 / N)


def likely_secrets(texts: list[str], gain: np.ndarray) -> list[list[tuple[int, int]]]:
    """(start, end) of the runs of token characters of each text whose log-likelihood ratio outweighs the prior; all runs are scored at once."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    flat = np.frombuffer("\n".join(["", *texts, ""]).encode("latin-1", "replace"), dtype=np.uint8)
    inside = IN_TOKEN[flat]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # begin, end, begin, end, ...
    first, end = edges[::2], edges[1::2]
    both = inside[1:] & inside[:-1]
    gains = np.where(both, gain.ravel()[CLASS[flat[:-1]] * N + CLASS[flat[1:]]], 0.0)
    sums = np.concatenate([[0.0], np.cumsum(gains)])
    hit = np.flatnonzero(sums[end - 1] - sums[first] >= -log(PRIOR))
    starts = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])])
    for a, b in zip(first[hit].tolist(), end[hit].tolist(), strict=True):
        at = int(np.searchsorted(starts, a, side="right")) - 1
        found[at].append((a - int(starts[at]), b - int(starts[at])))
    return found


def find(texts: list[str], gain: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """All spans of each text (start, kind's place, end), sorted."""
    out = []
    for text, rules, likely in zip(texts, worth_a_scan(texts)[0], likely_secrets(texts, gain), strict=True):
        spans = [(a, k, b) for a, k, b, _ in rule_spans(text)] if rules else []
        out.append(sorted(spans + [(a, 3, b) for a, b in likely if not any(s[0] < b and a < s[2] for s in spans)]))
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, kinds, starts, ends, text): spans by start, then kind; ends exclusive, in code points."""
    docs = common.text_rows(docs, id_col, text_col)
    random, ordinary = train(docs)
    gain = docs.sparkSession.sparkContext.broadcast(random - ordinary)  # 68 x 68 numbers

    def work(ids: list, texts: list[str]) -> dict:
        out = {"doc_id": ids, "kinds": [], "starts": [], "ends": []}
        for spans in find(texts, gain.value):
            out["kinds"].append([KINDS[k] for _, k, _ in spans])
            out["starts"].append([a for a, _, _ in spans])
            out["ends"].append([b for _, _, b in spans])
        return out

    return common.map_texts(docs, work, "doc_id long, kinds array<string>, starts array<int>, ends array<int>")


def is_kind(name: str):
    return lambda kind: kind == name


def digest(spans: DataFrame) -> DataFrame:
    """The columns (doc_id, n_assign, n_access, n_hex, base_sha256, spans) of a table of spans."""
    each = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")))
    rows = spans.select("doc_id", "kinds", each.alias("all"))
    counts = [F.size(F.filter("kinds", is_kind(x))).cast("long").alias(f"n_{x}") for x in KINDS]
    base = F.array_join(F.filter("all", lambda s: ~s.startswith("random:")), ",")
    return rows.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join("all", ",").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by ``mark`` and n_chars counted again; rows and columns stay."""
    random, ordinary = train(common.text_rows(docs))
    gain = docs.sparkSession.sparkContext.broadcast(random - ordinary)
    schema, at = docs.schema, docs.columns.index("text")

    def clean(texts: list) -> list:
        out = []
        for text, spans in zip(texts, find([t or "" for t in texts], gain.value), strict=True):
            if spans:
                end, parts = 0, []
                for a, _, b in spans:
                    if a >= end:
                        parts += [text[end:a], mark]
                    end = max(end, b)
                text = "".join([*parts, text[end:]])
            out.append(text)
        return out

    def run(batches):
        for batch in batches:
            column, done = batch.column(at), []
            for lo, hi, _ in common.text_chunks(column.fill_null("")):
                done += clean(column.slice(lo, hi - lo).to_pylist())
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    cleaned = docs.mapInArrow(run, schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned
