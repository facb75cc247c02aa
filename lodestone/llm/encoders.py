"""Token ids exactly as the tokenizer libraries give them, with a per-worker word cache."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# The word-splitting pattern and the normaliser of the vocabulary
# file whose words can be encoded one by one, as the file states them.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: The same split for texts that hold only characters of SIMPLE, where ``re`` and the library agree.
SIMPLE_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼½¾]+")
#: Anything else goes to the library whole: other scripts, combining marks, control characters, dotted capital I.
NOT_SIMPLE = re.compile(r"[^\t\n\r -~\xa0-įı-ɏ]")
#: Words in one generation of a worker's cache; the one before is kept too.
MOST_WORDS = 500_000


def resolve(tokenizer: str) -> str:
    """A path as it is, or the name of an installed public vocabulary file."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


class Encoder:
    """Ids of a text without begin, end or added special tokens."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = resolve(tokenizer)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.splits_words = False
        self.specials: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda text: model.encode(text, num_threads=1)
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_padding()
            self.library.no_truncation()
            self._ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            self.specials = [x["content"] for x in spec.get("added_tokens") or []]
            parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
            self.splits_words = (
                (parts[0].get("pattern") or {}).get("Regex") == WORD_SPLIT
                and parts[0].get("behavior") == "Removed"
                and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers") or []] == WORD_NORMALIZERS
                and not any(x["normalized"] for x in spec.get("added_tokens") or [])
            )

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.splits_words or NOT_SIMPLE.search(text) or any(x in text for x in self.specials):
            return np.asarray(self._ids(text), dtype="<u4").tobytes()
        found = SIMPLE_SPLIT.findall(text.lower())
        try:
            return b"".join(map(self.words.__getitem__, found))
        except KeyError:
            self._learn(set(found))
            return b"".join(map(self.words.__getitem__, found))

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4

    def _learn(self, found: set[str]) -> None:
        if len(self.words) > MOST_WORDS:
            self.older, self.words = self.words, {}
        missing = [x for x in found if x not in self.words]
        self.words.update((x, self.older[x]) for x in missing if x in self.older)
        new = [x for x in missing if x not in self.words]
        for word, x in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True):
            self.words[word] = np.asarray(x.ids, dtype="<u4").tobytes()

    def token_starts(self, text: str) -> list[int]:
        """The first character of each token, as the library reports its offsets."""
        return [a for a, _ in self.library.encode(text, add_special_tokens=False).offsets]


@lru_cache(maxsize=4)
def encoder(tokenizer: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(tokenizer)
