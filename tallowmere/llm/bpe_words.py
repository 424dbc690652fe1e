"""Exact byte-level BPE of whole texts, one space-separated word at a time.

The pre-tokenizer of the byte-level vocabularies never matches a non-space followed by a space, so in a
text whose spaces and line feeds each stand between two non-spaces, every one of them starts a new
pre-token. Such a text is the sum of its words; a worker encodes each distinct word once while its cache
has room. Any other text (double spaces, tabs, special strings and so on) goes to `tokenizers` whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

from tallowmere.llm.common import slices

#: Letters below this sign are letters in every Unicode version that a library here may carry.
SETTLED = "ɐ"
#: Signs outside the blocks whose classes have long been settled; a text that holds one goes to `tokenizers`.
UNSETTLED = re.compile("[^\\u0000-\\u024f\\u0410-\\u044f\\u2000-\\u206f\\u20ac\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3]")


def _byte_signs() -> dict[str, int]:
    """The signs that byte-level vocabularies write for bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def rank_encoding(path: str):
    """A tiktoken encoding with the same ids, or None where the file's merges are not in order of their ids."""
    import public_tokenizers
    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    signs, vocab = _byte_signs(), model["vocab"]
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab.get(j, -1) for j in joined]
    if model["type"] != "BPE" or any(a >= b for a, b in zip(ids, ids[1:])) or any(c not in signs for t in vocab for c in t):
        return None
    ranks = {bytes(signs[c] for c in t): k for t, k in vocab.items()}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    """The ids of whole texts as `tokenizers` gives them for a byte-level vocabulary file.

    The same merges run in tiktoken where the text holds no special string and no sign whose class may
    differ between the two libraries' Unicode tables; all else runs in `tokenizers` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = rank_encoding(path)

    def ids(self, text: str) -> list[int]:
        if self.ranks is None or UNSETTLED.search(text) or any(s in text for s in self.specials):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)


class _Words(dict):
    """Values by word; `spare` has those of the present slice that found no room."""

    spare: dict = {}

    def __missing__(self, word):
        return self.spare[word]


class WordEncoder:
    """Encodes texts to sums of per-word values.

    `value(ids)` makes what is kept for a word (a count, the ids' bytes), `total(values)` adds them up.
    `known` seeds the words that follow a space; at most `limit` words are kept besides.
    """

    def __init__(self, path: str, value: Callable, total: Callable, known: dict | None = None, limit: int = 200_000):
        self.texts = TextEncoder(path)
        self.specials, self.ranks, self.whole = self.texts.specials, self.texts.ranks, self.texts.ids
        self.value, self.total = value, total
        self.spaced, self.first = _Words(known or {}), _Words()
        self.limit = limit + len(self.spaced)
        self.line_feed = value(self.whole("\n"))
        self.empty = value([])

    def word(self, lead: str, word: str) -> list[int] | None:
        """The ids of a word; None if it isn't one that stands for itself."""
        if not word or word[0].isspace() or word[-1].isspace() or any(s in word for s in self.specials):
            return None
        if self.ranks is None:
            return self.whole(lead + word)
        if word.isalpha() and max(word) < SETTLED:
            return self.ranks._core_bpe.encode_single_piece((lead + word).encode())
        return self.ranks.encode_ordinary(lead + word)

    def _learn(self, cache: _Words, words: set, lead: str) -> None:
        cache.spare = new = {}
        for w in words.difference(cache):
            ids = self.word(lead, w)
            new[w] = None if ids is None else self.value(ids)
        if len(cache) + len(new) <= self.limit:
            cache.update(new)

    def encode(self, texts: list[str]) -> Iterator:
        """The total of each text, in order."""
        first, spaced = self.first.__getitem__, self.spaced.__getitem__
        for part in slices(texts):
            split = [[line.split(" ") for line in t.split("\n")] for t in part]
            tails: set = set()
            for lines in split:
                for line in lines:
                    tails.update(line[1:])
            self._learn(self.first, {line[0] for lines in split for line in lines}, "")
            self._learn(self.spaced, tails, " ")
            for t, lines in zip(part, split):
                values: list = []
                for line in lines:
                    values.append(first(line[0]))
                    values.extend(map(spaced, line[1:]))
                    values.append(self.line_feed)
                values.pop()
                if not t:
                    yield self.empty
                elif None in values:
                    yield self.value(self.whole(t))
                else:
                    yield self.total(values)
