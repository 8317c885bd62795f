"""Token ids from a public tokenizer file."""

from __future__ import annotations

from array import array

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

LATIN_END = "ɐ"


def _byte_letters() -> dict:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself,
    the other bytes, in order, for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class FileTokenizer:
    """Ids by the byte-level ``tokenizers`` file at ``path``. Texts in Latin letters are merged by ``tiktoken``
    under the ranks of the same file, which gives the same ids in less time; others go to ``tokenizers``.
    ``special_as_text``: strings of added tokens are ordinary text; without it they get the ids that the file gives
    them, as ``tokenizers`` does by default, and texts that hold one go to ``tokenizers``."""

    def __init__(self, path: str, special_as_text: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.apart = () if special_as_text else tuple(special)
        raw = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(raw[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        latin = text.isascii() or max(text) < LATIN_END
        ids = self.merge(text) if latin and not any(t in text for t in self.apart) else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.frombuffer(array("I", ids), np.uint32)

    def sentence_ends(self) -> np.ndarray:
        """By id: whether the token ends a sentence or a line (newline is U+010A in byte-level vocabularies)."""
        vocab = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            ends[i] = token.endswith((".", "!", "?")) or "Ċ" in token
        return ends
