"""Byte-level BPE ids of a public vocabulary file.

The vocabulary is that of the tokenizers file; merging is done by tiktoken over the same ranks,
which gives the ids of `tokenizers` (tests/llm compares them) at three to four times its speed.
Strings of special tokens inside a text are ordinary text.

Defined results: an empty text has no ids; any text gives itself back when its ids are decoded; a very
long text is encoded whole; callers give nulls as empty texts.
"""

from __future__ import annotations

import json

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files, by that scheme's rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        symbols = byte_symbols()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        own = {t["content"] for t in added}
        ranks = {bytes(symbols[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in own}
        #: Ids from here on are in no vocabulary: free for control tokens.
        self.size = max([*ranks.values(), *(t["id"] for t in added)]) + 1
        self.bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.bpe._core_bpe.encode_ordinary(text), dtype="<u4")

    def decode(self, ids) -> str:
        return self.bpe.decode_bytes([int(i) for i in ids]).decode("utf-8")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
