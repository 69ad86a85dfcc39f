"""Token ids of a byte-level BPE given as a ``tokenizers`` file.

The file's vocabulary and merges are handed to ``tiktoken``, whose ids are the
same where the merges come in the order of their ids (checked on loading);
texts that hold the string of a special token go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: how byte-level BPE divides a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes texts as one ``tokenizers`` file does without adding special tokens."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte = spec["model"]["vocab"], _byte_of()
        self.special = [t["content"] for t in spec["added_tokens"]]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        plain = spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
        if spec["model"]["type"] != "BPE" or not plain or spec.get("normalizer") or merged != sorted(merged):
            raise ValueError(f"{path} is not a plain byte-level BPE with merges in the order of their ids")
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each file and worker."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
