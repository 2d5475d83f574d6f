"""Byte-level BPE ids from a public vocabulary file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def entries(vocabulary: str) -> list[bytes]:
    """The bytes of each id."""
    with open(vocabulary, encoding="utf-8") as file:
        ids, of = json.load(file)["model"]["vocab"], byte_of_symbol()
    made = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        made[i] = bytes(of[c] for c in token)
    return made


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Merges run in tiktoken, several times as fast as tokenizers on the same vocabulary; ids are equal (tests hold them together).

    The vocabulary's added tokens are taken out of the text before the merges and keep their own ids, as tokenizers does.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)
    special, of = {x["content"]: x["id"] for x in model["added_tokens"]}, byte_of_symbol()
    ranks = {bytes(of[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def patient_encoder(vocabulary: str, plain: bool):
    """For texts on which the pattern's backtracking gives up (some hundred thousand blanks in a row): slower, the same ids."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary)
    made.encode_special_tokens = plain
    return made


def encode(text: str, vocabulary: str, plain: bool = False) -> np.ndarray:
    """The ids of a text; ``plain``: strings of added tokens in it are ordinary text."""
    quick = encoder(vocabulary)
    try:
        return quick.encode_to_numpy(text, allowed_special=set() if plain else "all", disallowed_special=())
    except ValueError:
        return np.array(patient_encoder(vocabulary, plain).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encode_plain(texts: list[str], vocabulary: str) -> list[np.ndarray]:
    return [encode(text, vocabulary, plain=True) for text in texts]


def lengths(texts: list[str], vocabulary: str) -> list[int]:
    return [len(encode(text, vocabulary)) for text in texts]
