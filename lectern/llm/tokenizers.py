"""Public tokenizers, loaded once per Python worker from a folder that is a parameter."""

from __future__ import annotations

import base64
import os
from functools import cache

FOLDER = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
#: The pattern that splits text before the merges of the byte-level rank files (fixed value of that tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def byte_bpe(folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken"):
    """Byte-level BPE; `encode_ordinary_batch` and `decode` round-trip any text."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def piece_bpe(folder: str = FOLDER, name: str = "piece_bpe_32k.model"):
    """BPE over characters that falls back to bytes; ids of byte pieces come with it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))
    return model, frozenset(i for i in range(model.get_piece_size()) if model.is_byte(i))


def count_tokens(text: str, enc) -> int:
    """Tokens of a whole text; the merges of a run without white space take no more than n log n steps, so no text is cut."""
    return len(enc.encode_ordinary(text))
