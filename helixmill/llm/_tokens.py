"""Token ids of a public byte-level BPE vocabulary.

The vocabulary comes as ranks, which encode several times faster than the library that defines
the ids; tests hold both to the same ids. The special token's string in a text is that token.
"""

from __future__ import annotations

import base64

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the vocabulary's special token.
SPECIAL = {"<|endoftext|>": 50256}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict[str, tiktoken.Encoding] = {}
_plain: dict[str, Tokenizer] = {}


def encoder(path: str) -> tiktoken.Encoding:
    """The worker's encoder of this vocabulary, read once."""
    if path not in _encoders:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def plain(path: str) -> Tokenizer:
    """The worker's encoder by the library that defines the ids: the JSON file of the same name."""
    if path not in _plain:
        _plain[path] = Tokenizer.from_file(f"{path.removesuffix('.tiktoken')}.json")
    return _plain[path]


def ids(path: str, text: str | None) -> np.ndarray:
    """The ids of a whole text (null: none), unsigned 32-bit. Texts whose runs of white space are too long for the fast encoder's backtracking take the plain one."""
    if not text:
        return np.zeros(0, "<u4")
    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4")
    except ValueError:
        return np.array(plain(path).encode(text, add_special_tokens=False).ids, "<u4")
