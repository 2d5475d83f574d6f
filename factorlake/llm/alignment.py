"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, counted over the whole corpus.

A text is encoded by a byte-level BPE (A, of space + text) and by a piece model (B, which adds the space). Both cut the same bytes, so
the union of their token ends cuts them into segments, each within one token of either side: one segment is one link. Ends that both
sides share close a group.

Counting spills: a task packs its links as (partition of b, b, a, document) into integers, sorts ``RUN_LINKS`` of them at a time and
writes one zstd run for each of ``PARTS`` radix partitions: the pairs with their totals, and apart from them the documents of each
pair. Runs go to the shared folder, so texts are encoded once. A pair column is then merged by a k-way heap of sorted runs, in order of
the B side, which counts each pair; as that order keeps a B id together, its maximum follows, and a second reading of the
runs streams each pair's count back to the documents that hold it. All runs of a partition may be too many for one task (a B id, or a
pair, may be most of the corpus), so a partition's runs are dealt over as many salts as ``GROUP_BYTES`` of them ask for, counts of
the salts are added by pair, and the counted pairs go to every salt.

Defined cases: null and empty texts, and those whose tokens don't give the bytes of space + text, have no tokens: zeros and ''. Null and
repeated ids are rows like others; an empty table gives no rows; ties for a B id's highest count all count as best; other columns aren't
read. A text is encoded whole, so a task needs memory for the tokens of its longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Radix partitions of the B ids; each is a power of two's share of mixed ids.
PARTS = 32
#: Links that a task sorts into one set of runs.
RUN_LINKS = 4_000_000
#: Documents of one set of runs.
RUN_DOCS = 1 << 20
#: Bytes of runs that one group of a merge holds, about.
GROUP_BYTES = 16_000_000
#: Pairs of a run that a merge takes at once.
BLOCK = 1 << 16

ROWS = "doc_id long, chunk long, local int, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, part int, pairs binary, docs binary"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """A vocabulary: the bytes of its tokens, and its ids in decimal, packed into 8 bytes with the mark that follows them."""

    def __init__(self, entries: list[bytes], marks: str):
        self.bytes, self.size = entries, np.array([len(x) for x in entries], dtype=np.int32)
        written = [[str(i).encode() + m.encode() for i in range(len(entries))] for m in marks]
        self.text = np.array([[int.from_bytes(x, "little") for x in line] for line in written], dtype=np.uint64)
        self.digits = np.array([[len(x) for x in line] for line in written], dtype=np.int64)


@lru_cache(maxsize=2)
def byte_side(vocabulary: str) -> Side:
    return Side(tokens.entries(vocabulary), ",|")


@lru_cache(maxsize=2)
def piece_side(model: str) -> tuple:
    """(the model, its side): a piece is its UTF-8 with U+2581 as a space, a byte piece is its byte."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [(pieces.id_to_piece(i), pieces.is_byte(i)) for i in range(pieces.vocab_size())]
    return pieces, Side([bytes([int(x[3:5], 16)]) if byte else x.replace("▁", " ").encode() for x, byte in names], ",;\0")


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integers, each array in the least width and by byte planes, compressed."""
    parts = []
    for values in arrays:
        kind = np.min_scalar_type(int(values.max(initial=0)))
        parts.append(np.array([len(values), kind.itemsize], dtype="<u8").tobytes())
        parts.append(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, made = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        count, width = np.frombuffer(raw, dtype="<u8", count=2, offset=at).astype(np.int64).tolist()
        planes = np.frombuffer(raw, dtype=np.uint8, count=count * width, offset=at + 16).reshape(width, count)
        made.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 16 + count * width
    return made


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


class Layout:
    """A link as one integer: partition, B id, A id, document, from the highest bits on."""

    def __init__(self, size_a: int, size_b: int):
        self.doc, self.a = RUN_DOCS.bit_length(), size_a.bit_length()
        b = size_b.bit_length()
        if PARTS.bit_length() - 1 + b + self.a + self.doc > 63:
            raise ValueError(f"vocabularies of {size_a} and {size_b} entries don't fit into 63 bits with {RUN_DOCS} documents")
        with np.errstate(over="ignore"):
            part = (common.mix(np.arange(size_b, dtype=np.uint64)) % np.uint64(PARTS)).astype(np.int64)
        self.high = ((part << b | np.arange(size_b)) << self.a) << self.doc
        self.b_mask, self.a_mask, self.part_at = (1 << b) - 1, (1 << self.a) - 1, b + self.a


class Chunk:
    """Links of some texts, and what each text gets."""

    def __init__(self, texts: list[str], vocabulary: str, model: str, layout: Layout, written: bool):
        a_side, (pieces, b_side) = byte_side(vocabulary), piece_side(model)
        whole = [b" " + t.encode() if t else b"" for t in texts]
        a_ids = tokens.encode_plain([" " + t if t else "" for t in texts], vocabulary)
        b_ids = pieces.encode(texts, num_threads=1)
        for i, text in enumerate(whole):
            if text and not (text == b"".join(map(a_side.bytes.__getitem__, a_ids[i].tolist())) == b"".join(map(b_side.bytes.__getitem__, b_ids[i]))):
                whole[i] = b""
        used = [i for i, text in enumerate(whole) if text]
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(len(texts), dtype=np.int64) for _ in range(4))
        self.groups, self.sha, self.links = [""] * len(texts), [""] * len(texts), np.zeros(0, dtype=np.int64)
        if not used:
            return
        self.n_a[used], self.n_b[used] = [len(a_ids[i]) for i in used], [len(b_ids[i]) for i in used]
        a, b = np.concatenate([a_ids[i] for i in used]).astype(np.int64), np.concatenate([np.array(b_ids[i], dtype=np.int64) for i in used])
        a_ends, b_ends = np.cumsum(a_side.size[a]), np.cumsum(b_side.size[b])
        doc_ends = np.cumsum([len(whole[i]) for i in used])

        is_a, is_b = (np.zeros(doc_ends[-1] + 1, dtype=bool) for _ in range(2))
        is_a[a_ends], is_b[b_ends] = True, True
        upto_a, upto_b = np.cumsum(is_a, dtype=np.int32), np.cumsum(is_b, dtype=np.int32)
        cuts, shared = np.flatnonzero(is_a | is_b), np.flatnonzero(is_a & is_b)
        links = np.diff(np.searchsorted(cuts, doc_ends, side="right"), prepend=0)
        self.n_links[used], self.n_groups[used] = links, np.diff(np.searchsorted(shared, doc_ends, side="right"), prepend=0)
        self.links = layout.high[b[upto_b[cuts - 1]]] | a[upto_a[cuts - 1]] << layout.doc | np.repeat(np.array(used), links)

        upto = np.cumsum(is_a & is_b, dtype=np.int32)
        a_before, b_before = upto_a[shared], np.concatenate([[0], upto_b[shared][:-1]])  # tokens of A up to a group's end, of B before its start
        last_a, last_b = is_a[a_ends] & is_b[a_ends], (is_a[b_ends] & is_b[b_ends]).astype(np.int64)
        last_b[np.cumsum(self.n_b[used]) - 1] = 2
        a_at, b_at = np.arange(len(a)) + b_before[upto[a_ends - 1]], np.arange(len(b)) + a_before[upto[b_ends - 1]]
        line, width = np.zeros(len(a) + len(b), dtype=np.uint64), np.zeros(len(a) + len(b), dtype=np.int64)
        line[a_at], line[b_at] = a_side.text[last_a.astype(np.int64), a], b_side.text[last_b, b]
        width[a_at], width[b_at] = a_side.digits[last_a.astype(np.int64), a], b_side.digits[last_b, b]
        line = line.view(np.uint8)
        line = memoryview(line[line != 0].tobytes())
        ends = np.cumsum(width)[np.cumsum(self.n_a[used] + self.n_b[used]) - 1] - np.arange(1, len(used) + 1)  # a text's last token has no mark
        for i, lo, hi in zip(used, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            self.sha[i] = hashlib.sha256(line[lo:hi]).hexdigest()
            if written:
                self.groups[i] = bytes(line[lo:hi]).decode()


def runs_of(links: np.ndarray, layout: Layout) -> Iterator[tuple[int, bytes, bytes]]:
    """(partition, pairs, documents of the pairs) of sorted links."""
    links = np.sort(links)
    starts = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]]))
    times = np.diff(np.append(starts, len(links)))
    links = links[starts]
    pairs, docs = links >> layout.doc, links & ((1 << layout.doc) - 1)
    bounds = np.searchsorted(pairs >> layout.part_at, np.arange(PARTS + 1))
    for part, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if lo == hi:
            continue
        own, m, d = pairs[lo:hi], times[lo:hi], docs[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        held = np.diff(np.append(first, hi - lo))
        steps = np.diff(d, prepend=0)
        steps[first] = d[first]
        yield part, pack(deltas(own[first]), np.add.reduceat(m, first), held), pack(steps, m)


def encode_runs(docs: DataFrame, vocabulary: str, model: str, written: bool) -> DataFrame:
    """Rows of two kinds (``ROWS``): a document (part is null), or one run of a chunk of documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ROWS))
    per_doc = ["doc_id", "chunk", "local", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256"]

    def rows(columns: dict) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def flush(links: list[np.ndarray], chunk: int, layout: Layout) -> Iterator[pa.RecordBatch]:
        for part, pairs, of in runs_of(np.concatenate(links), layout):
            yield rows({"chunk": [chunk], "part": [part], "pairs": [pairs], "docs": [of]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(len(byte_side(vocabulary).bytes), len(piece_side(model)[1].bytes))
        chunk, local, held, links = common.partition_id() << 32, 0, 0, []
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, texts in common.text_chunks(batch.column("text")):
                made = Chunk(texts, vocabulary, model, layout, written)
                where = np.arange(local, local + len(texts))
                yield rows(dict(zip(per_doc, [ids[lo:hi], [chunk] * len(texts), where, made.n_a, made.n_b, made.n_groups, made.n_links, made.groups, made.sha], strict=True)))
                links.append(made.links + local)
                local, held = local + len(texts), held + len(made.links)
                if held >= RUN_LINKS or local + common.CHUNK_TEXTS > RUN_DOCS:
                    yield from flush(links, chunk, layout) if held else ()
                    chunk, local, held, links = chunk + 1, 0, 0, []
        if held:
            yield from flush(links, chunk, layout)

    return common.text_rows(docs).mapInArrow(run, ROWS)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (keys, counts) to blocks of distinct keys in order with their sums.

    The heap holds each run's next block by its last key: the least of them bounds what every run may give now.
    """
    at = [0] * len(runs)
    heap = [(int(keys[min(BLOCK, len(keys)) - 1]), i) for i, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        bound, taken, counts = heap[0][0], [], []
        for i in [i for _, i in heap]:
            keys, of = runs[i]
            to = at[i] + int(np.searchsorted(keys[at[i] : at[i] + BLOCK], bound, side="right"))
            taken.append(keys[at[i] : to])
            counts.append(of[at[i] : to])
            at[i] = to
        while heap and heap[0][0] <= bound:
            i = heap[0][1]
            if at[i] < len(runs[i][0]):
                heapq.heapreplace(heap, (int(runs[i][0][min(at[i] + BLOCK, len(runs[i][0])) - 1]), i))
            else:
                heapq.heappop(heap)
        keys, of = np.concatenate(taken), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys, of = keys[order], of[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield keys[starts], np.add.reduceat(of, starts)


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): per document its counts, its links' counts and its groups (their text if ``written``, else ''); per pair (b, a) its links and the highest count of its b."""
    vocabulary, model = vocabulary or tokens.default_vocabulary(), model or default_pieces()
    stored = common.store(encode_runs(docs, vocabulary, model, written))
    layout = Layout(len(byte_side(vocabulary).bytes), len(piece_side(model)[1].bytes))
    a_bits, a_mask, b_mask = layout.a, layout.a_mask, layout.b_mask

    runs = stored.where("part is not null")
    sizes = {r["part"]: r["bytes"] for r in runs.groupBy("part").agg(F.sum(F.length("pairs") + F.length("docs")).alias("bytes")).collect()}  # PARTS rows
    salts = [max(1, math.ceil(sizes.get(part, 0) / GROUP_BYTES)) for part in range(PARTS)]
    of_part = F.element_at(F.array(*map(F.lit, salts)), F.col("part") + 1)
    runs = runs.withColumn("salt", F.pmod(F.xxhash64("chunk"), of_part).cast("int"))

    def count(group: pa.Table) -> pa.Table:
        unpacked = (unpack(x.as_py()) for x in group.column("pairs"))
        blocks = [*merged([(np.cumsum(steps), n) for steps, n, _ in unpacked])]
        keys, n = (np.concatenate(x) for x in zip(*blocks, strict=True))
        return pa.table({"part": pa.array(np.full(len(keys), group.column("part")[0].as_py()), pa.int32()), "b": keys >> a_bits & b_mask, "a": keys & a_mask, "key": keys, "n": n})

    counted = runs.select("part", "salt", "pairs").groupBy("part", "salt").applyInArrow(count, "part int, b long, a long, key long, n long")
    pairs = counted.groupBy("b", "a", "part", "key").agg(F.sum("n").alias("n")).withColumn("highest", F.max("n").over(Window.partitionBy("b")))
    pairs = common.store(pairs)

    def table(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys, n, best = (group.column(c).to_numpy() for c in ("key", "n", "best"))
        return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "table": pa.array([pack(deltas(keys), n, best.astype(np.int64))], pa.binary())})

    tables = pairs.select("part", "key", "n", (F.col("n") == F.col("highest")).alias("best")).groupBy("part").applyInArrow(table, "part int, table binary")
    tables = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), of_part - 1)))

    def give_back(own: pa.Table, counts: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        steps, n, best = unpack(counts.column("table")[0].as_py())
        keys = np.cumsum(steps)
        for chunk, pairs_, docs_ in zip(own.column("chunk").to_pylist(), own.column("pairs"), own.column("docs"), strict=True):
            steps, _, held = unpack(pairs_.as_py())
            at = np.repeat(np.searchsorted(keys, np.cumsum(steps)), held)
            steps, m = unpack(docs_.as_py())
            first = np.cumsum(held) - held
            local = np.cumsum(steps)
            local -= np.repeat(local[first] - steps[first], held)  # steps begin anew with each pair
            sums = np.zeros((2, int(local.max()) + 1), dtype=np.int64)
            np.add.at(sums[0], local, m * best[at])
            np.add.at(sums[1], local, m * n[at])
            seen = np.flatnonzero(sums[1])
            out.append(pa.table({"chunk": pa.array(np.full(len(seen), chunk)), "local": pa.array(seen, pa.int32()), "n_best": sums[0, seen], "count_sum": sums[1, seen]}))
        return pa.concat_tables(out) if out else pa.schema([("chunk", pa.int64()), ("local", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())]).empty_table()

    given = runs.select("part", "salt", "chunk", "pairs", "docs").groupBy("part", "salt").cogroup(tables.select("part", "salt", "table").groupBy("part", "salt"))
    given = given.applyInArrow(give_back, "chunk long, local int, n_best long, count_sum long").groupBy("chunk", "local").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    per_doc = stored.where("part is null").drop("part", "pairs", "docs").join(given, ["chunk", "local"], "left").fillna(0, ["n_best", "count_sum"]).drop("chunk", "local")
    return per_doc, pairs.select("b", "a", "n", "highest")


def digest(per_doc: DataFrame) -> DataFrame:
    return per_doc.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
