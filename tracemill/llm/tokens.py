"""Token ids from a public vocabulary, on the executors."""

from __future__ import annotations

import base64
import os

import numpy as np

#: Folder of vocabulary files; a parameter of each operator that needs tokens.
VOCABULARIES = os.environ.get("TRACEMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's publishers split text before merging bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters given to the tokenizer at once. Longer texts are cut before a space that follows a
#: letter, where the split cuts anyway, so that the ids are those of the whole text.
PIECE = 1 << 17
_loaded: dict[str, object] = {}


def encoding(folder: str = VOCABULARIES, name: str = VOCABULARY):
    path = os.path.join(folder, name)
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _pieces(text: str) -> list[str]:
    out, a = [], 0
    while len(text) - a > PIECE:
        b = a + PIECE
        while b > a + 1 and not (text[b] == " " and text[b - 1].isalpha()):
            b -= 1
        if b <= a + 1:
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


def ids(text: str | None, folder: str = VOCABULARIES, name: str = VOCABULARY) -> np.ndarray:
    """The token ids of text, whole; strings of special tokens are ordinary text."""
    if not text:
        return np.zeros(0, np.uint32)
    e = encoding(folder, name)._core_bpe
    parts = [np.frombuffer(e.encode_to_tiktoken_buffer(p, set()), np.uint32) for p in _pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
