"""Papers as text: cleaning, metadata, references, chunks, stored fact responses, mentions."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Without form feeds, words joined over line ends, blank runs as one blank, at most one empty line in a row."""
    text = F.regexp_replace(text, "\f", "\n")
    text = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def paper_metadata(text: Column) -> Column:
    """struct<title, year, abstract>: the first line, the first year from 1900 on, what stands between Abstract and Introduction."""
    title = F.trim(F.split(F.trim(text), "\n", 2)[0])
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    abstract = F.trim(F.regexp_extract(text, r"(?is)\babstract\b[:.\s]*(.*?)(?:\n\s*\n|\bintroduction\b|\z)", 1))
    return F.struct(title.alias("title"), year.alias("year"), abstract.alias("abstract"))


def strip_references(text: Column) -> Column:
    """The text up to a line that is the heading References or Bibliography."""
    return F.split(text, r"(?im)^\s*(?:references|bibliography)\s*$", 2)[0]


def chunk_paragraph(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text): paragraphs between empty lines, trimmed; empty ones go."""
    parts = F.filter(F.transform(F.split(F.col(text_col), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("chunk_index", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "text")


def chunk_fixed(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text): pieces of ``size`` characters, each beginning ``overlap`` before the end of the one before."""
    stride, n = size - overlap, F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / stride).cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col, F.explode(starts).alias("chunk_index"))
    piece = F.substring(F.col(text_col), F.col("chunk_index") * stride + 1, F.lit(size))
    return rows.select(F.format_string("%s_chunk_%04d", F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", piece.alias("text"))


#: Where a text may be cut, the best first.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters that end at the best separator a text has; neighbours share whole parts of up to ``overlap`` characters.

    A part begins with the separator before it. One that is too long is split at the next separators, or stays whole if it has none.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    first, *others = text.split(separators[at])
    out: list[str] = []
    held: deque[str] = deque()
    length = 0

    def emit() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in filter(None, [first, *(separators[at] + p for p in others)]):
        if len(part) >= size:
            emit()
            held.clear()
            length = 0
            out += split_text(part, size, overlap, separators[at + 1 :]) if separators[at + 1 :] else [part]
            continue
        if held and length + len(part) > size:
            emit()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.popleft())
        held.append(part)
        length += len(part)
    emit()
    return out


def chunk_overlap(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text): overlapping pieces that end at paragraphs, lines, sentences or words, by ``split_text``."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces(F.coalesce(F.col(text_col), F.lit("")))).alias("chunk_index", "text"))
    return rows.select(F.format_string("%s_chunk_%04d", F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", "text")


FACTS = "array<struct<signal_name:string,description:string,asset_class:string,holding_period:string,formation_period:string,ic_reported:double,sharpe_reported:double,return_reported:double,paper_title:string,year:int>>"


def facts_parse(responses: DataFrame) -> DataFrame:
    """One row for each fact of stored responses (chunk_id, response); code fences go, invalid responses are skipped."""
    body = F.regexp_extract(F.col("response"), r"(?s)(\[.*\])", 1)
    rows = responses.select("chunk_id", F.explode(F.from_json(body, FACTS, {"mode": "PERMISSIVE"})).alias("fact")).where("fact.signal_name is not null")
    return rows.select("fact.*", F.col("chunk_id").alias("source_chunk_id"))


def ticker_mentions(messages: DataFrame, known: DataFrame, keyword: str = r"\b(?:stock|share|price|ticker|quote|chart)\b") -> DataFrame:
    """messages(id, text) with ``ticker``: the first known symbol among the words; else a word of one to five capitals if a keyword occurs."""
    words = messages.select("id", F.posexplode(F.split("text", r"[^A-Za-z0-9.]+")).alias("at", "word"))
    found = words.join(known.select(F.col("symbol").alias("word")).distinct(), "word").groupBy("id").agg(F.min_by("word", "at").alias("symbol"))
    guess = F.when(F.lower("text").rlike(keyword), F.nullif(F.regexp_extract("text", r"\b([A-Z]{1,5})\b", 1), F.lit("")))
    return messages.join(found, "id", "left").select("id", "text", F.coalesce("symbol", guess).alias("ticker"))


def composite_score(confidence: Column, most_similar: Column, relevance: Column) -> Column:
    return 0.4 * confidence + 0.3 * (1 - most_similar) + 0.3 * relevance


def decision_narrative(results: DataFrame) -> DataFrame:
    """results(name, ic, icir, p_value, sharpe, max_drawdown) with a sentence on each and warnings by thresholds."""
    strength = F.when(F.abs("icir") >= 1.0, "strong").when(F.abs("icir") >= 0.5, "moderate").otherwise("weak")
    text = F.format_string("%s: %s signal, IC %.3f, ICIR %.2f, Sharpe %.2f.", F.col("name"), strength, F.col("ic"), F.col("icir"), F.col("sharpe"))
    warnings = F.concat_ws("; ", F.when(F.col("p_value") >= 0.05, "not causal at 5%"), F.when(F.col("max_drawdown") < -0.2, "drawdown beyond 20%"), F.when(F.col("sharpe") < 1.0, "Sharpe below 1"))
    return results.withColumn("narrative", text).withColumn("warnings", warnings)
