"""Byte-level BPE of whole texts from a ``tokenizers`` file.

``tiktoken`` runs the file's merges, as it takes a quarter of the time and returns arrays; the ``tokenizers`` library
takes any text that ``tiktoken`` refuses, such as a million blanks in a row. Both give the same ids: the file's
numbering is checked on loading, and the tests compare both libraries on every code point.
"""

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from tallybook.llm.common import held

# The pattern that byte-level BPE splits texts by: fixed value of that format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def symbol_bytes() -> dict[str, int]:
    """The byte that each symbol stands for: printable Latin-1 for itself, symbols from U+0100 on for the other bytes in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Texts to ids. With ``special``, strings of special tokens in a text give their ids; else they are plain text."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, symbols = spec["model"], symbol_bytes()
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level vocabularies without normaliser and prefix are supported")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The bytes of every token that merges make, by id.
        self.token_bytes = {i: bytes([symbols[c] for c in t]) for t, i in model["vocab"].items() if t not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if made != sorted(made) or len(made) + 256 != len(self.token_bytes):
            raise ValueError("ids must follow the order of the merges")
        self.special = special
        self.fast = tiktoken.Encoding(
            "byte-level", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.token_bytes.items()}, special_tokens=added
        )
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all" if self.special else set(), disallowed_special=())
        except ValueError:  # its pattern needs more stack than it has
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def loaded(path: str, special: bool = True) -> ByteBpe:
    """This Python worker's encoder."""
    return held(("byte_bpe", path, special), lambda: ByteBpe(path, special))
