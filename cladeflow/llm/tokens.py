"""Token ids of whole texts by the tokenizers library, one call per distinct word.

The word-level vocabulary never joins characters across ASCII white space, so a text's
ids are the ids of its words in a row; each worker keeps those of the words it has seen,
a bounded number.
"""

from __future__ import annotations

import json
import os

import numpy as np

from cladeflow.llm.common import worker_store

#: Words kept by a worker; beyond it the store starts anew.
CACHE_WORDS = 400_000
#: Signs that may follow a word as one piece of their own; an apostrophe is none of them, as it begins contractions.
SIGNS = b".,;:!?%#$&*|<>\"()-"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Stems(dict):
    """Ids of words without the signs after them, case folded, worked out when first asked for."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokenize, self.letters, self.packed, self.encode = tokenizer.tokenizer.model.tokenize, tokenizer.letters, tokenizer.packed, tokenizer.encode

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        # Letters that no normal form changes are one word to the merges, its case folded already.
        if self.letters and (word.isalpha() or (text.isalpha() and max(text) < "\u0100")):
            if not word.isalpha():
                text = text.lower().encode().decode("latin-1").translate(self.letters)
            packed = self.packed
            got = b"".join([packed[t.id] for t in self.tokenize(text)])
        else:
            got = np.array(self.encode(text), dtype="<u4").tobytes()
        self[word] = got
        return got


class _Words(dict):
    """Ids of words; those that differ in case or in the signs after the last letter share a stem."""

    def __init__(self, stems: _Stems):
        self.stems = stems

    def __missing__(self, word: bytes) -> bytes:
        low = word if b"<|" in word else word.lower()  # a special token is matched before case is folded
        stem = low.rstrip(SIGNS)
        if len(stem) < len(low) and (stem.isalpha() or stem.decode().isalpha()):
            got = self.stems[stem] + self.stems[low[len(stem) :]]
        else:
            got = self.stems[low]
        self[word] = got
        return got


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = self.byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = _Words(_Stems(self))

    def byte_letters(self) -> dict[int, str]:
        """The letter that stands for each byte, if this vocabulary folds case and writes words byte by byte; else none."""
        spec = json.loads(self.tokenizer.to_str())
        folds = {"type": "Lowercase"} in (spec.get("normalizer") or {}).get("normalizers", [])
        if not folds or '"ByteLevel"' not in json.dumps(spec["pre_tokenizer"]) or spec["model"]["type"] != "BPE":
            return {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out = []
        words = self.words
        for text in texts:
            out.append(b"".join(map(words.__getitem__, text.split())))
            if len(words) > CACHE_WORDS:
                words.clear()
            if len(words.stems) > CACHE_WORDS:
                words.stems.clear()
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and path."""
    loaded = worker_store("word_tokenizer")
    if path not in loaded:
        loaded[path] = WordTokenizer(path)
    return loaded[path]
