"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker as far as memory allows.

A byte-level tokenizer splits before every single space that a non-space follows, so a text without two white-space characters
in a row is encoded word by word with the same ids. Other texts go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .text_arrays import remembered

#: Words that a worker remembers unless told otherwise, about 170 MB.
REMEMBERED = 700_000
#: Longer words aren't remembered.
LONGEST = 64
#: Words that are encoded in one text, and characters that are encoded in one call: the library keeps much besides the ids.
TOGETHER, CALL_CHARS = 64, 1 << 18
#: Letters up to U+024F, and signs after them that no pattern joins with letters.
_LETTERS_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?%$*&#)]*)\Z")
_ADJACENT = re.compile(r"\s\s")


def _is_split_by_single_spaces(text: str) -> bool:
    """Whether no two white-space characters stand side by side, and no character is one that keys are marked with."""
    plain = text.replace("\n", " ")
    # what is printable holds no white space but the space
    if plain.isprintable():
        return "  " not in plain
    return "\0" not in text and not _ADJACENT.search(text)


#: The coders of this worker by vocabulary file.
CODERS: dict[str, WordCoder] = remembered("coders")


class WordCoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        # an own text for each key: "x" stands for " x", "\nx" for itself, "\0x" for "x" at the begin of a text
        self.known: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        line_end = self.tokenizer.encode("a\n b", add_special_tokens=False).ids
        self.line_end = line_end[1] if len(line_end) == 3 else None

    @staticmethod
    def of(path: str, remembered: int = REMEMBERED) -> WordCoder:
        """The coder of this worker for a vocabulary file; it remembers so many words."""
        if path not in CODERS:
            # tasks are on all cores already
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            CODERS[path] = WordCoder(path, remembered)
        return CODERS[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= CALL_CHARS:
                size += len(texts[end])
                end += 1
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def _runs(self, runs: list[str]) -> list[bytes]:
        """The ids of runs of letters, each after a space: many in one text, told apart by the line ends between them."""
        out: list[bytes] = []
        texts = [" " + "\n ".join(runs[i : i + TOGETHER]) for i in range(0, len(runs), TOGETHER)]
        for k, text in enumerate(self._library(texts)):
            ids = np.frombuffer(text, "<u4")
            ends = np.flatnonzero(ids == self.line_end)
            own = runs[k * TOGETHER : (k + 1) * TOGETHER]
            if len(ends) != len(own) - 1:
                raise ValueError("the vocabulary does not keep a line end apart")
            ids, at = ids.tobytes(), 0
            for end in (*(4 * ends).tolist(), len(ids)):
                out.append(ids[at:end])
                at = end + 4
        return out

    def _encoded(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of words that aren't known yet."""
        known, new = self.known, {"\0": b""}
        # letters and the signs after them are encoded apart by the vocabulary too
        plain = [k for k in missing if k.isascii() and k.isalpha()]
        split = [(k, m[1], m[2]) for k in set(missing).difference(plain) if (m := _LETTERS_SIGNS.match(k))]
        runs = list(dict.fromkeys([*plain, *(r for _, r, _ in split if r not in known)]))
        if self.line_end is not None:
            new.update(zip(runs, self._runs(runs), strict=True))
        else:
            new.update(zip(runs, self._library([" " + r for r in runs]), strict=True))
        signs = list(dict.fromkeys(x for _, _, x in split if x and x not in self.signs))
        self.signs.update(zip(signs, self._library(signs), strict=True))
        for k, r, x in split:
            new[k] = (known.get(r) or new[r]) + (self.signs[x] if x else b"")
        rest = [k for k in missing if k not in new]
        plain = [k if k[:1] == "\n" else k[1:] if k[:1] == "\0" else " " + k for k in rest]
        new.update(zip(rest, self._library(plain), strict=True))
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        get, found = self.known.get, []
        missing: set[str] = set()
        for t in texts:
            if not _is_split_by_single_spaces(t):
                found.append((None, None))
                continue
            keys = t.replace("\n", " \n").split(" ")
            # a text that begins with white space begins with an empty word
            keys[0] = "\0" + keys[0]
            ids = list(map(get, keys))
            gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            missing.update([keys[i] for i in gaps])
            found.append((ids, [(i, keys[i]) for i in gaps]))
        new = self._encoded(list(missing))
        if len(self.known) < self.remembered:
            self.known.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        if len(self.signs) > self.remembered:
            self.signs.clear()
        whole = iter(self._library([t for t, (ids, _) in zip(texts, found, strict=True) if ids is None]))
        out = []
        for ids, gaps in found:
            if ids is None:
                out.append(next(whole))
                continue
            for i, k in gaps:
                ids[i] = new[k]
            out.append(b"".join(ids))
        return out
