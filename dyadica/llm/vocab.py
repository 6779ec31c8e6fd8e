"""Public tokenizer vocabularies; the folder is a parameter and nothing of it is copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Where the vocabulary files are; the environment of the executors must have it too.
FOLDER = "/opt/tokenizers"

#: The pattern that splits a text before the merges of the rank files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(name: str, folder: str = FOLDER) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(name: str, folder: str = FOLDER):
    """The public library's encoder of a rank file, without special tokens; kept by each worker."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=read_ranks(name, folder), special_tokens={})


@lru_cache(maxsize=4)
def counter(name: str, folder: str = FOLDER):
    """A function from a list of texts to their numbers of tokens, or None if there is no such tokenizer."""
    if os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
        enc = encoding(name, folder)
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if os.path.exists(os.path.join(folder, f"{name}.model")):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
        return lambda texts: [len(sp.encode(t)) for t in texts]
    if os.path.exists(os.path.join(folder, f"{name}.json")):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
        t.encode_special_tokens = True
        return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    return None
