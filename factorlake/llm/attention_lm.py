"""Language-model scoring: a small causal self-attention model on subword ids, trained in numpy where the data lie.

The model gives the next subword id in two steps: one attention layer over the last ``Shape.context`` ids gives a class, and the corpus
gives the id within its class. Classes, shares of ids within them, and how classes follow each other come from counts over
all training text (``Classes``); the layer learns what the counts leave open.

Training is data-parallel, in ``ROUNDS`` passes over disjoint windows, together one in ``every`` of every part of the training text (1: all), so it grows with
the input: every task starts from the broadcast parameters, takes Adam steps on its own windows and sends its change, weighted by its
targets, as integers; their sum is the same in any order. Only the parameters, whose size no input changes, are on the driver.

Scoring cuts a text into windows of ``context`` ids that overlap: each scores its last ``stride`` ids, so every id is scored once, with at
least context - stride ids before it (where the text begins, marks of its start). Windows of many texts run as one batch under a causal mask.

The unigram base: words are runs of anything but ASCII white space, A-Z lower-cased, and one end a text; (c + 1) / (N + V + 1). Words of more
than 1 / ``HOT_WORDS`` of all are at most so many and are looked up by broadcast, the others by a join on the word.

Defined cases: a null or empty text is its end alone; a null doc_id has no hold-out mark and is not learned from; without training text
every word is unknown and the model is uniform over ids; repeated rows count again; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

FOLDS, HELD_OUT = 7, 2
#: Words of a larger share than one in this many are looked up by broadcast: at most so many words of ``HOT_BYTES`` bytes.
HOT_WORDS, HOT_BYTES = 200_000, 64
#: Words in a task's counter before they are sent on.
ENTRIES = 500_000
ROUNDS = 4
#: Windows of a training step and of a scoring batch.
STEP, BATCH = 32, 64
#: Unless a caller says otherwise one window of a training text in this many takes part in training, whatever the input's size; counts take all. The query trains on every window.
EVERY = 16
RATE = 0.01
#: Changes are summed as integers in these units, times the number of targets.
UNIT = 1 << 20
#: Parameters in one row of a task's change.
BLOCK = 1 << 14


@dataclass(frozen=True)
class Shape:
    """Fixed sizes of the model: none depends on the input."""

    context: int = 24
    stride: int = 16
    width: int = 24
    heads: int = 1
    classes: int = 96
    own_rows: int = 4_096


class Classes:
    """From counts over all training text: a class for each id, and each id's share within its class.

    First ids that begin with a blank and all others are cut by frequency into classes of about equal share. Then the ``own_rows`` most
    frequent ids are grouped anew by the classes that stand before and after them (k-means on the square roots of their shares,
    weighted by count): ids of one use share a class, so the class tells much and the id within it little.
    """

    def __init__(self, counts: np.ndarray, blank: np.ndarray, shape: Shape):
        self.shape, self.counts = shape, counts
        order, mass = np.lexsort([-counts, blank]), counts + 1.0
        middle = np.cumsum(mass[order]) - mass[order] / 2
        self.of = np.empty(len(counts), dtype=np.int64)
        self.of[order] = np.minimum((middle / mass.sum() * shape.classes).astype(np.int64), shape.classes - 1)
        by_count = np.argsort(-counts, kind="stable")
        self.frequent = by_count[: shape.own_rows]
        self.frequent = self.frequent[counts[self.frequent] > 0]
        self.place = np.full(len(counts), -1)
        self.place[self.frequent] = np.arange(len(self.frequent))
        self.settle()

    def settle(self) -> None:
        size = self.shape.classes
        self.row = np.where(self.place >= 0, self.place, self.shape.own_rows + self.of).astype(np.int32)
        within = np.bincount(self.of, weights=self.counts + 1.0, minlength=size)
        self.log_within = np.log((self.counts + 1.0) / within[self.of])
        self.log_class = np.log(np.maximum(within, 1e-9) / within.sum())

    def regroup(self, around: np.ndarray, rounds: int = 10) -> None:
        """around: for each of the frequent ids how often each class stands before it, and after it."""
        if len(around) <= self.shape.classes:
            return
        sides = around.reshape(len(around), 2, -1)
        points = np.sqrt(sides / np.maximum(sides.sum(axis=2, keepdims=True), 1)).reshape(len(around), -1)
        weights, centres = self.counts[self.frequent], points[: self.shape.classes].copy()
        for _ in range(rounds):
            nearest = ((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)
            total = np.bincount(nearest, weights=weights, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, points * weights[:, None])
            centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centres)
        rare = np.bincount(nearest[len(nearest) * 7 // 8 :], minlength=len(centres)).argmax()  # where the least frequent of them mostly are
        self.of[:] = rare
        self.of[self.frequent] = nearest
        self.settle()


def start(shape: Shape, seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    rows, d = shape.own_rows + shape.classes, shape.width
    drawn = lambda *size, by: (r.standard_normal(size) * by).astype(np.float32)
    return {
        "embed": drawn(rows, d, by=0.3), "query": drawn(d, d, by=d**-0.5), "key": drawn(d, d, by=d**-0.5), "value": drawn(d, d, by=d**-0.5), "own": drawn(d, d, by=d**-0.5),
        "mix": drawn(d, d, by=d**-0.5), "shift": np.zeros(d, np.float32), "distance": np.zeros((shape.heads, shape.context), np.float32), "out": np.zeros((shape.classes, d), np.float32),
        "bias": np.zeros(shape.classes, np.float32),
    }


def squash(x: np.ndarray) -> np.ndarray:
    """x / sqrt(1 + x^2): between -1 and 1 like tanh, at a third of its cost."""
    return x / np.sqrt(1 + x * x)


class Model:
    """One attention layer; ``prior`` holds the log of each class's share after each class, counted."""

    def __init__(self, shape: Shape, follow: np.ndarray, params: dict[str, np.ndarray]):
        self.shape, self.p, self.tables = shape, params, None
        self.prior = follow.astype(np.float32)
        s, c = shape.stride, shape.context
        gap = (np.arange(c - s, c)[:, None] - np.arange(c)[None, :]).astype(np.int64)
        self.seen, self.gap = gap >= 0, np.maximum(gap, 0)

    def heads(self, x: np.ndarray) -> np.ndarray:
        n, length, _ = x.shape
        return x.reshape(n, length, self.shape.heads, -1).transpose(0, 2, 1, 3)

    def forward(self, rows: np.ndarray, last: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """rows: (n, context) embedding rows; last, target: (n, stride) classes of the ids before the targets, and theirs. Shares of classes, not normalised, and what the gradient needs."""
        p, s = self.p, self.shape
        x = p["embed"][rows]
        x_q = x[:, -s.stride :]
        q, k, v = self.heads(x_q @ p["query"]), self.heads(x @ p["key"]), self.heads(x @ p["value"])
        scores = (q * np.float32((s.width // s.heads) ** -0.5)) @ k.transpose(0, 1, 3, 2)
        scores += np.where(self.seen, p["distance"][:, self.gap], np.float32(-1e9))
        np.minimum(scores, np.float32(60), out=scores)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=-1, keepdims=True)
        mixed = (scores @ v).transpose(0, 2, 1, 3).reshape(-1, s.width)
        hidden = x_q.reshape(-1, s.width) @ p["own"]
        hidden += mixed @ p["mix"]
        hidden += p["shift"]
        hidden = squash(hidden)
        shares = hidden @ p["out"].T  # bounded: |hidden| < 1
        shares += self.prior[last.ravel()]
        shares += p["bias"]
        at_target = shares[np.arange(target.size), target.ravel()]
        np.exp(shares, out=shares)
        return {"x": x, "q": q, "k": k, "v": v, "attention": scores, "mixed": mixed, "hidden": hidden, "at_target": at_target, "shares": shares, "total": shares.sum(axis=-1, keepdims=True)}

    def log_class(self, rows: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of the targets' classes; what depends on one input alone is a table of the rows, made once."""
        p, s = self.p, self.shape
        if self.tables is None:
            scale = np.float32((s.width // s.heads) ** -0.5)
            self.tables = {"q": p["embed"] @ p["query"] * scale, "k": p["embed"] @ p["key"], "v": p["embed"] @ p["value"], "own": p["embed"] @ p["own"] + p["shift"]}
            self.mask, self.out = np.where(self.seen, p["distance"][:, self.gap], np.float32(-1e9)), np.ascontiguousarray(p["out"].T)
        t, targets, last = self.tables, np.ascontiguousarray(rows[:, -s.stride :]), last.ravel()
        q, k, v = (self.heads(t[name].take(at, axis=0)) for name, at in (("q", targets), ("k", rows), ("v", rows)))
        scores = q @ k.transpose(0, 1, 3, 2)
        scores += self.mask
        np.minimum(scores, np.float32(60), out=scores)  # within what exp holds
        np.exp(scores, out=scores)
        mixed = scores @ v
        mixed /= (scores @ np.ones(s.context, np.float32))[..., None]
        hidden = t["own"].take(targets.ravel(), axis=0)
        hidden += mixed.transpose(0, 2, 1, 3).reshape(-1, s.width) @ p["mix"]
        logits = squash(hidden) @ self.out
        logits += self.prior.take(last, axis=0)
        logits += p["bias"]
        at_target = logits[np.arange(target.size), target.ravel()]
        np.exp(logits, out=logits)
        return at_target - np.log(logits @ np.ones(s.classes, np.float32))

    def gradient(self, rows: np.ndarray, last: np.ndarray, target: np.ndarray, used: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability of the used targets."""
        p, s, m = self.p, self.shape, self.forward(rows, last, target)
        n = len(rows)
        d_logits = m["shares"]
        d_logits /= m["total"]
        d_logits[np.arange(target.size), target.ravel()] -= 1
        d_logits *= (used.ravel() / max(used.sum(), 1)).astype(np.float32)[:, None]
        hidden = m["hidden"]
        rest = 1 - hidden * hidden
        d_pre = (d_logits @ p["out"]) * rest * np.sqrt(rest)
        x_q, mixed = m["x"][:, -s.stride :].reshape(-1, s.width), m["mixed"]
        grads = {"out": d_logits.T @ hidden, "bias": d_logits.sum(axis=0), "own": x_q.T @ d_pre, "mix": mixed.T @ d_pre, "shift": d_pre.sum(axis=0)}
        d_mixed = self.heads((d_pre @ p["mix"].T).reshape(n, s.stride, s.width))
        a = m["attention"]
        d_v, d_a = a.transpose(0, 1, 3, 2) @ d_mixed, d_mixed @ m["v"].transpose(0, 1, 3, 2)
        d_scores = a * (d_a - (d_a * a).sum(axis=-1, keepdims=True))
        by_gap = (d_scores.sum(axis=0) * self.seen).reshape(s.heads, -1)
        grads["distance"] = np.stack([np.bincount(self.gap.ravel(), weights=g, minlength=s.context) for g in by_gap]).astype(np.float32)
        d_scores *= np.float32((s.width // s.heads) ** -0.5)
        flat = lambda g: g.transpose(0, 2, 1, 3).reshape(-1, s.width)
        d_q, d_k, d_v = flat(d_scores @ m["k"]), flat(d_scores.transpose(0, 1, 3, 2) @ m["q"]), flat(d_v)
        x = m["x"].reshape(-1, s.width)
        grads |= {"query": x_q.T @ d_q, "key": x.T @ d_k, "value": x.T @ d_v}
        d_x = (d_k @ p["key"].T + d_v @ p["value"].T).reshape(n, s.context, s.width)
        d_x[:, -s.stride :] += (d_pre @ p["own"].T + d_q @ p["query"].T).reshape(n, s.stride, s.width)
        order = np.argsort(rows.ravel(), kind="stable")
        sorted_rows = rows.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        grads["embed"] = (sorted_rows[first], np.add.reduceat(d_x.reshape(-1, s.width)[order], first, axis=0))
        return grads


class Adam:
    """Steps on a copy of the parameters; rows of the embedding that a step doesn't touch stay as they are."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = {k: v.copy() for k, v in params.items()}, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.t += 1
        for name, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m, v = self.m[name][at] * 0.9 + 0.1 * g, self.v[name][at] * 0.99 + 0.01 * g * g
            self.m[name][at], self.v[name][at] = m, v
            self.p[name][at] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)


class Windows:
    """Texts (ids with their end) cut into overlapping windows: views of one line in which every text begins at a multiple of the stride."""

    def __init__(self, texts: list[np.ndarray], classes: Classes, shape: Shape, end: int):
        c, s = shape.context, shape.stride
        before = -(-(c - s + 1) // s) * s  # marks of a text's start
        sizes = np.array([before + -(-len(t) // s) * s for t in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        line, used = np.full(int(sizes.sum()), end, dtype=np.int32), np.zeros(int(sizes.sum()), dtype=bool)
        for at, t in zip((begins + before).tolist(), texts, strict=True):
            line[at : at + len(t)] = t
            used[at : at + len(t)] = True
        used = used.reshape(-1, s)
        self.block = np.flatnonzero(used[:, 0])  # blocks of s targets
        text = np.repeat(np.arange(len(texts)), sizes // s)
        self.text, self.used = text[self.block], used[self.block]
        self.within = classes.log_within[line].reshape(-1, s)
        rows, of = classes.row[line], classes.of[line].astype(np.int32)
        view = np.lib.stride_tricks.sliding_window_view
        self._rows, self._last, self._of = (view(rows, c) if len(rows) >= c else None), (view(of, s) if len(of) >= s else None), of.reshape(-1, s)
        self.lead, self.stride = c - s + 1, s

    def __len__(self) -> int:
        return len(self.block)

    def batch(self, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the inputs, classes before the targets, classes of the targets, which targets count) of some windows."""
        block = self.block[at]
        return self._rows[block * self.stride - self.lead], self._last[block * self.stride - 1], self._of[block], self.used[at]


def log10_probabilities(model: Model, classes: Classes, texts: list[np.ndarray], end: int) -> np.ndarray:
    """log10 of each text's probability, its end included."""
    w, s = Windows(texts, classes, model.shape, end), model.shape.stride
    sums = np.zeros(len(w))
    for lo in range(0, len(w), BATCH):
        rows, last, target, used = w.batch(slice(lo, lo + BATCH))
        sums[lo : lo + BATCH] = ((model.log_class(rows, last, target).reshape(-1, s) + w.within[w.block[lo : lo + BATCH]]) * used).sum(axis=1)
    return np.bincount(w.text, weights=sums, minlength=len(texts)) / np.log(10)


def flatten(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflatten(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([0, *[like[k].size for k in sorted(like)]])
    return {k: values[lo:hi].reshape(like[k].shape).astype(np.float32) for k, lo, hi in zip(sorted(like), ends[:-1], ends[1:], strict=True)}


@lru_cache(maxsize=1)
def vocabulary_size(vocabulary: str) -> int:
    return len(tokens.entries(vocabulary))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training texts of (held_out, text); the empty word is the end of a text."""

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*counts], type=pa.binary()), pa.array([*counts.values()], type=pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                counts.update(text.as_py().lower().split())
                counts[b""] += 1
                if len(counts) >= ENTRIES:
                    yield sent(counts)
                    counts = Counter()
        yield sent(counts)

    return docs.where("not held_out").select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def sampled_windows(ids: np.ndarray, row: int, shape: Shape, end: int, every: int) -> np.ndarray:
    """(n, context + 1) ids of one window in ``every`` of a text (ids without its end); which ones depends on the number of its row."""
    c, s = shape.context, shape.stride
    line = np.concatenate([np.full(c - s + 1, end), ids, np.full(s + 1, end)]).astype("<u4")
    number = np.arange(-row % every, len(ids) // s + 1, every)
    return np.lib.stride_tricks.sliding_window_view(line, c + 1)[number * s]


def prepare(docs: DataFrame, hot, total: int, distinct: int, vocabulary: str, shape: Shape, every: int) -> DataFrame:
    """A row a text: its number, its base without rare words, those words, its subword ids, and the windows that train."""
    known_at, floor, end = hot, np.log10(total + distinct + 1), vocabulary_size(vocabulary) - 1

    def work(ids: list, texts: list[str]) -> dict:
        of, out, place = known_at.value, {k: [] for k in ("n_tokens", "n_known", "base", "rare", "times", "ids", "row", "windows")}, (common.partition_id() << 36) + work.rows
        work.rows += len(texts)
        for row, text in enumerate(texts, place):
            lower = text.encode().lower()
            words = lower.split()
            counts = Counter(words)
            counts[b""] = 1
            held, n = [*counts], np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
            log_c = np.array([*map(of.get, held)], dtype=np.float64)  # not a number where the word is not among the frequent
            known = log_c == log_c
            base, n_known = float(log_c[known] @ n[known]) - (len(words) + 1) * floor, int(n[known].sum())
            rare, times = [*compress(held, ~known)], n[~known]
            made = tokens.encode(lower.decode(), vocabulary, plain=True).astype("<u4")
            windows = sampled_windows(made, row, shape, end, every).tobytes() if every > 1 else b""  # all of them are cut from the ids
            for key, value in (("n_tokens", len(words) + 1), ("n_known", n_known), ("base", base), ("rare", rare), ("times", times), ("ids", made.tobytes()), ("row", row), ("windows", windows)):
                out[key].append(value)
        return out | {"doc_id": ids}

    work.rows = 0
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare array<binary>, times array<long>, ids binary, windows binary"
    return common.map_texts(docs, work, schema, carried=("held_out",))


def train(rows: DataFrame, vocabulary: str, shape: Shape, rounds: int = ROUNDS, every: int = EVERY) -> tuple[Classes, np.ndarray, dict[str, np.ndarray]]:
    """(classes, how they follow each other, parameters) from all training rows of ``prepare``."""
    size = vocabulary_size(vocabulary)
    end, spark = size - 1, rows.sparkSession
    texts = rows.where("not held_out").select("ids")

    def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, _, made in id_chunks(batch.column("ids"), end):
                counts += np.bincount(np.concatenate(made), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    counts = np.zeros(size)
    for r in texts.select("ids").mapInArrow(count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id of the vocabulary
        counts[r["id"]] = r["n"]
    classes = Classes(counts, np.array([x[:1] == b" " for x in tokens.entries(vocabulary)]), shape)
    before = spark.sparkContext.broadcast((classes.of, classes.place))

    def count_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of, place), wide = before.value, shape.classes
        cells = np.zeros(shape.own_rows * 2 * wide, dtype=np.int64)
        for batch in batches:
            for _, _, made in id_chunks(batch.column("ids"), end):
                ids = np.concatenate([part for x in made for part in ([end], x)])
                for own, other, side in ((ids[1:], ids[:-1], 0), (ids[:-1], ids[1:], 1)):
                    held = place[own] >= 0
                    cells += np.bincount((place[own[held]] * 2 + side) * wide + of[other[held]], minlength=len(cells))
        seen = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(cells[seen])], names=["cell", "n"])

    around = np.zeros(shape.own_rows * 2 * shape.classes)
    found = texts.select("ids").mapInArrow(count_around, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # own_rows * 2 * classes rows at most
    around[found["cell"].to_numpy()] = found["n"].to_numpy()
    classes.regroup(around.reshape(shape.own_rows, -1)[: len(classes.frequent)])
    sent_classes = spark.sparkContext.broadcast(classes)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs = sent_classes.value.of, np.zeros(shape.classes**2, dtype=np.int64)
        for batch in batches:
            for _, _, made in id_chunks(batch.column("ids"), end):
                line = of[np.concatenate([part for x in made for part in ([end], x)])]  # an end, then the next text: as a text begins
                pairs += np.bincount(line[:-1] * shape.classes + line[1:], minlength=len(pairs)) - np.bincount([of[end] * shape.classes + of[end]], minlength=len(pairs)) * (len(made) - 1)
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(pairs[seen])], names=["pair", "n"])

    follow = np.zeros(shape.classes**2)
    for r in texts.select("ids").mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # classes * classes rows at most
        follow[r["pair"]] = r["n"]
    follow = follow.reshape(shape.classes, shape.classes) + shape.classes * np.exp(classes.log_class)[None, :]
    follow = np.log(follow / follow.sum(axis=1, keepdims=True))

    params = start(shape)
    for number in range(rounds if counts.sum() else 0):
        params = one_round(rows.where("not held_out").select("row", "windows" if every > 1 else "ids"), params, sent_classes, follow, shape, end, number, rounds, every)
    return classes, follow, params


def one_round(texts: DataFrame, params: dict, sent_classes, follow: np.ndarray, shape: Shape, end: int, number: int, rounds: int, every: int) -> dict[str, np.ndarray]:
    """Every task's steps on its sampled windows of this round from the same parameters; the mean change by targets."""
    spark, s = texts.sparkSession, shape.stride
    sent, rate = spark.sparkContext.broadcast((params, follow)), RATE * (1 - number / (rounds + 1))

    def of_round(batch: pa.RecordBatch) -> np.ndarray:
        made = [np.zeros((0, shape.context + 1), dtype="<u4")]
        for row, value in zip(batch.column("row").to_pylist(), batch.column("windows" if every > 1 else "ids"), strict=True):
            held = np.frombuffer(value.as_py(), dtype="<u4")
            own = held.reshape(-1, shape.context + 1) if every > 1 else sampled_windows(held, row, shape, end, 1)
            made.append(own[(number - row // every) % rounds :: rounds])  # a text's windows go to the rounds in turn
        return np.concatenate(made)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (before, after), classes, targets = sent.value, sent_classes.value, 0
        adam = Adam(before, rate)
        model, waiting = Model(shape, after, adam.p), np.zeros((0, shape.context + 1), dtype="<u4")

        def step(ids: np.ndarray) -> int:
            is_end = ids[:, -s:] == end
            used = np.cumsum(is_end, axis=1) - is_end == 0  # behind a text's end nothing counts
            adam.step(model.gradient(classes.row[ids[:, :-1]], classes.of[ids[:, -s - 1 : -1]], classes.of[ids[:, -s:]], used))
            return int(used.sum())

        for batch in batches:
            waiting = np.concatenate([waiting, of_round(batch)])
            full = len(waiting) // STEP * STEP
            for at in range(0, full, STEP):
                targets += step(waiting[at : at + STEP])
            waiting = waiting[full:]
        targets += step(waiting) if len(waiting) else 0
        change = np.rint((flatten(adam.p) - flatten(before)) * UNIT).astype(np.int64) * targets
        for block, at in enumerate(range(0, len(change), BLOCK) if targets else ()):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([targets]), pa.array([change[at : at + BLOCK].tobytes()], type=pa.binary())], names=["block", "targets", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = {}, Counter()
        for batch in batches:
            for block, n, change in zip(*[batch.column(c).to_pylist() for c in ("block", "targets", "change")], strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(change, dtype=np.int64)
                weights[block] += n
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([weights[block]]), pa.array([total.tobytes()], type=pa.binary())], names=["block", "targets", "change"])

    form = "block long, targets long, change binary"
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    values = flatten(params).astype(np.float64)
    for r in texts.mapInArrow(steps, form).repartition(slots, "block").mapInArrow(add, form).collect():  # the parameters, once
        change = np.frombuffer(r["change"], dtype=np.int64) / (UNIT * max(r["targets"], 1))
        values[r["block"] * BLOCK : r["block"] * BLOCK + len(change)] += change
    return unflatten(values, params)


def id_chunks(column: pa.Array, end: int, ids: int = 500_000) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    lo, held, made = 0, 0, []
    for i, value in enumerate(column):
        made.append(np.append(np.frombuffer(value.as_py(), dtype="<u4"), end).astype(np.int64))
        held += len(made[-1])
        if held >= ids:
            yield lo, i + 1, made
            lo, held, made = i + 1, 0, []
    if made:
        yield lo, len(column), made


def score(docs: DataFrame, vocabulary: str | None = None, shape: Shape = Shape(), rounds: int = ROUNDS, every: int = EVERY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every text."""
    vocabulary, spark = vocabulary or tokens.default_vocabulary(), docs.sparkSession
    end = vocabulary_size(vocabulary) - 1
    texts = common.text_rows(docs).withColumn("held_out", common.crc_mod("doc_id", FOLDS) == HELD_OUT)
    words = common.store(word_counts(texts))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = words.where((F.col("c") * HOT_WORDS > total) & (F.length("word") <= HOT_BYTES)).collect()  # at most HOT_WORDS words
    hot = spark.sparkContext.broadcast({bytes(r["word"]): float(np.log10(r["c"] + 1.0)) for r in often})

    rows = common.store(prepare(texts, hot, total, distinct, vocabulary, shape, every))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    found = rare.join(words.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_base"))

    classes, follow, params = train(rows, vocabulary, shape, rounds, every)
    sent = spark.sparkContext.broadcast((classes, follow, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, after, learned = sent.value
        model = Model(shape, after, learned)
        for batch in batches:
            sums = [log10_probabilities(model, of, made, end) for _, _, made in id_chunks(batch.column("ids"), end, ids=100_000)]
            kept = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(sums) if sums else [], type=pa.float64())], names=[*kept.schema.names, "score"])

    scored = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
