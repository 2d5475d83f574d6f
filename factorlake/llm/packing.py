"""Packing: sum-of-squares online packing of documents into token windows.

Each task packs the documents of its own input partition as they come: no shuffle, no driver work, and a lost task
packs the same rows again. A document fills whole windows first; its rest goes to the fill level that
minimises the sum of squared counts of partially filled windows, tracked in an array with one count for each level.

Windows that are still partial when a task's rows end, or when more than OPEN of them are held (documents of one size above half a
window never meet a partner), keep what the levels gave them: the fullest are filled up with tokens cut from the emptiest, so
only the emptiest are taken apart. The last one is cut at powers of two, which need no padding. A task holds the ids
of at most OPEN partial windows, 32 MB for windows of 2048.

Defined cases: a null or empty text is the end mark alone; rows that repeat a doc_id are packed one by one.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 1
#: Partial windows that a task holds at once.
OPEN = 4_096


class Levels:
    """Partially filled windows by level; counts[h] of them hold h tokens."""

    def __init__(self, window: int) -> None:
        self.window, self.counts, self.open = window, np.zeros(window + 1, dtype=np.int64), {}

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece (doc_id, start, ids, doc_tokens) in a window; the window's pieces if that fills it."""
        size, counts = len(piece[2]), self.counts
        # a window that goes from level h to h + size changes the sum of squares by 2 * (counts[h + size] - counts[h]) + 2,
        # by one less if it is new (h = 0) or then full, since neither state is counted
        change = 2 * (counts[size:] - counts[: len(counts) - size]) + 2
        change[0] -= 1
        change[-1] -= 1
        change[1:][counts[1 : len(counts) - size] == 0] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(change[::-1].argmin())  # of equals the fullest
        held = self.open[level].pop() if level else []
        if level:
            counts[level] -= 1
        held.append(piece)
        if level + size == self.window:
            return held
        counts[level + size] += 1
        self.open.setdefault(level + size, []).append(held)
        return None

    def held(self) -> int:
        return int(self.counts.sum())

    def drain(self, last: bool) -> Iterator[list[tuple]]:
        """Close all partial windows, the fullest first, with tokens cut from the emptiest; what is left of those becomes
        one partial window again or, at the end, windows at powers of two."""
        partial = deque((level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level])
        self.counts[:], self.open = 0, {}
        rest: list[tuple] = []  # of the emptiest window, pieces to be cut from
        while partial:
            level, pieces = partial.popleft()
            while level < self.window:
                if not rest:
                    if not partial:
                        break
                    rest = partial.pop()[1]
                part, tail = cut_piece(rest.pop(), self.window - level)
                pieces.append(part)
                level += len(part[2])
                if tail:
                    rest.append(tail)
            if level == self.window:
                yield pieces
            else:
                rest = pieces
        if rest and last:
            yield from powers(rest)
        elif rest:
            level = sum(len(p[2]) for p in rest)
            self.counts[level] += 1
            self.open[level] = [rest]


def cut_piece(piece: tuple, most: int) -> tuple[tuple, tuple | None]:
    """The first ``most`` tokens of a piece, and the rest if there is any."""
    doc, start, ids, whole = piece
    return (doc, start, ids[:most], whole), (doc, start + most, ids[most:], whole) if len(ids) > most else None


def powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """Windows at powers of two, largest first, of less than a window's tokens."""
    total, left = sum(len(p[2]) for p in pieces), pieces[::-1]
    while total:
        goal, made = 1 << (total.bit_length() - 1), []
        total -= goal
        while goal:
            part, tail = cut_piece(left.pop(), goal)
            made.append(part)
            goal -= len(part[2])
            if tail:
                left.append(tail)
        yield made


def pack(docs: DataFrame, window: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of at most ``window`` ids."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, made, sequence = Levels(window), [[] for _ in range(7)], common.partition_id() << 40

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, whole in pieces:
                for column, value in zip(made, (doc, start, len(ids), zlib.crc32(ids.tobytes()), whole, sequence, offset), strict=True):
                    column.append(value)
                offset += len(ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            nonlocal made
            batch, made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], [x.split()[0] for x in SCHEMA.split(", ")]), [[] for _ in range(7)]
            return batch

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(tokens.encode(text.as_py(), vocabulary), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = (doc, at, ids[at : at + window].copy(), len(ids))
                    full = [piece] if len(piece[2]) == window else levels.place(piece)
                    if full:
                        put(full)
                if levels.held() > OPEN:
                    for pieces in levels.drain(last=False):
                        put(pieces)
            yield out()
        for pieces in levels.drain(last=True):
            put(pieces)
        yield out()

    return common.text_rows(docs, id_col, text_col).mapInArrow(run, SCHEMA)
