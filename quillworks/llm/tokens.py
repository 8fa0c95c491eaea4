"""Token counts by a public tokenizer's ranks file, whose path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern that belongs to the ranks file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in parts of at most this many characters, cut at spaces, so that no run of one
#: kind of character makes the encoder's time grow with its square.
PART = 20_000


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str):
    i, n = 0, len(text)
    while i < n:
        j = min(n, i + PART)
        if j < n:
            k = text.rfind(" ", i + 1, j)
            j = k if k > i else j
        yield text[i:j]
        i = j


def count(text: str | None, path: str = DEFAULT_RANKS) -> int:
    """Tokens of a text; 0 for null and empty texts."""
    if not text:
        return 0
    e = encoder(path)
    return sum(len(e.encode_ordinary(p)) for p in _parts(text))
