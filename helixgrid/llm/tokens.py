"""Byte-level BPE token ids of whole texts.

The vocabulary file (ranks of byte strings) is a parameter; the ids are those
that the same vocabulary's tokenizers file gives without added special tokens,
including the one id of a special token's string that stands in a text.
"""

from __future__ import annotations

import base64

import numpy as np

#: The one special token of the 50k vocabulary, fixed by its tokenizers file.
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """text -> uint32 ids. Loading takes a moment, so make one per task."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        return self.encoding.encode_to_numpy(text, allowed_special="all")
