"""Token ids of whole texts by a public tokenizer, with a cache of words."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words a worker remembers at most; about 200 bytes each.
CACHE_WORDS = 400_000
#: Texts with other characters than these, or with a special token's opening, take the library's own path.
ODD = re.compile(r"[^\t\n\r -~¡-ÿ]|<\|")
#: The split pattern of the word-level file and its form for texts without ODD characters, lower case.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


class Words(dict):
    """Ids of a word; the library's BPE model is asked for those not yet known."""

    def __init__(self, model, dtype: np.dtype) -> None:
        self.model, self.dtype, self.letters = model, dtype, byte_letters()

    def __missing__(self, word: str) -> bytes:
        asked = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(asked)], self.dtype).tobytes()
        if len(self) < CACHE_WORDS:  # the words seen first hold nearly all frequent ones
            self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts as little-endian ids, equal to the tokenizer's own `encode(text, add_special_tokens=False)`.

    If the file is a BPE over lower-case words that drops white space, texts of Latin-1 letters are split here and each
    word's ids come from the library's model once and then from the cache; other texts and files go through the library.
    """

    _shared: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = norms == ["NFC", "Replace", "Lowercase"] and (steps[0].get("pattern") or {}).get("Regex") == WORD_SPLIT and not steps[-1].get("add_prefix_space")
        self.words = Words(self.tokenizer.model, self.dtype)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder a worker process and file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of self.dtype; null is empty."""
        get, split, odd = self.words.__getitem__, LATIN_SPLIT.findall, ODD.search
        return [b"".join(map(get, split(t.lower()))) if self.by_word and not odd(t) else self.whole(t) for t in (t or "" for t in texts)]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
