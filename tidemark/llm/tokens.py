"""Token ids of the byte-level BPE vocabulary."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import tiktoken


@lru_cache(maxsize=2)
def _reference(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids as ``tokenizers`` gives them for the byte-level file at ``path``, without added special tokens.

    The ids come from a quicker reader of the same vocabulary, whose ids are the ranks of the merges. Texts that its
    pattern engine cannot take (very long runs of one kind) go to ``tokenizers`` itself.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    own = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return own.encode(text, allowed_special="all")
        except BaseException as e:
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            return _reference(path).encode(text, add_special_tokens=False).ids

    return encode
