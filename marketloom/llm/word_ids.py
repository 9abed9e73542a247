"""Token ids of whole texts by a vocabulary that drops white space and marks the end of each pre-token.

No pre-token of such a vocabulary reaches over white space, so a text is encoded word by word, each distinct word once per worker as far as
memory allows. New words go to the library many in one text; the pieces that end a pre-token tell them apart again.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .text_arrays import remembered
from .token_count import pre_tokens, split_words

#: Words that a worker remembers unless told otherwise, about 150 MB; longer ones aren't remembered.
REMEMBERED, LONGEST = 700_000, 64
#: Words that are encoded in one text, and in one call.
TOGETHER, CALL = 64, 1 << 15
#: Letters, and signs after them that no pattern joins with letters: two pre-tokens.
_LETTERS_SIGNS = re.compile(r"([a-z]+)([.,;:!?%$*&#)]+)\Z")
#: What the vocabulary's last piece of a pre-token ends with.
WORD_END = "</w>"
#: The encoders of this worker by vocabulary file.
ENCODERS: dict[str, WordEnds] = remembered("word_ids")


class WordEnds:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes, two where the vocabulary allows it."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are on all cores already
        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> WordEnds:
        """The encoder of this worker for a vocabulary file."""
        if path not in ENCODERS:
            ENCODERS[path] = WordEnds(path)
        return ENCODERS[path]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), CALL):
            out += [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)]
        return out

    def _told_apart(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, many encoded in one text."""
        new: dict[str, bytes] = {}
        alone = []
        for at in range(0, len(words), TOGETHER * 256):
            lots = [words[i : i + TOGETHER] for i in range(at, min(len(words), at + TOGETHER * 256), TOGETHER)]
            for lot, ids in zip(lots, self._library([" ".join(lot) for lot in lots]), strict=True):
                last = np.flatnonzero(self.ends[ids]) + 1
                stops = np.cumsum([len(pre_tokens(w)) for w in lot])
                if len(last) != stops[-1]:
                    alone += lot  # a word that the library splits in its own way
                    continue
                text, width = ids.tobytes(), self.kind.itemsize
                at_, ends = 0, (last[stops - 1] * width).tolist()
                for w, end in zip(lot, ends, strict=True):
                    new[w] = text[at_:end]
                    at_ = end
        new.update(zip(alone, (x.tobytes() for x in self._library(alone)), strict=True))
        return new

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't known. Capitals and signs behind letters don't make a word a new one."""
        known, parts, ask = self.known, {}, {}
        for w in words:
            low = w.lower() if w.isascii() else w
            m = None if low.isalpha() else _LETTERS_SIGNS.match(low)
            own = parts[w] = m.groups() if m else (low,)
            for x in own:
                if x not in known:
                    ask[x] = None
        told = self._told_apart(list(ask))
        new = {w: b"".join([known.get(x) or told[x] for x in own]) for w, own in parts.items()}
        if len(known) < self.remembered:
            known.update((x, ids) for x, ids in told.items() if len(x) <= LONGEST)
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        get, found = self.known.get, []
        missing: set[str] = set()
        for t in texts:
            words = split_words(t)
            ids = list(map(get, words))
            gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            own = [words[i] for i in gaps]
            missing.update(own)
            found.append((ids, gaps, own))
        new = self._encoded(list(missing)) if missing else {}
        for ids, gaps, own in found:
            for i, w in zip(gaps, own, strict=True):
                ids[i] = new[w]
        if len(self.known) < self.remembered:
            self.known.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST)
        return [b"".join(ids) for ids, _, _ in found]
