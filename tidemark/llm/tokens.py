"""Token ids of whole texts by a word-end BPE, with each part of a text between blanks encoded once."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np

from .base import held

#: Parts that a worker keeps, some 200 bytes each, before it starts afresh.
CACHE_PARTS = 900_000
#: Words that the tokenizer is given at a time.
TOGETHER = 2000
#: Signs that may follow a word, and never are of one token with it; how many of them are kept as one end.
SIGNS, END_SIGNS = string.punctuation, 3
#: Letters before this one are normalized as they stand, and so are words of them.
COMBINING = "\u0300"


def part_encoder(path: str) -> PartEncoder:
    """The worker's encoder: tasks that run in a worker one after another know what those before have met, until
    another operator's run there."""
    return held(f"parts of {path}", lambda: PartEncoder(path))


class PartEncoder:
    """ids of a text as those of its parts between blanks, joined; each as little-endian 16-bit numbers.

    It holds for tokenizers that put text into lower case, drop white space and part words from signs, so that
    no token spans a blank or a word's end. All ids come from the tokenizers library: words of letters in one
    call for many, told apart by the suffix of each word's last token, anything else by itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        # for words already in lower case and apart, the same model without the passes that put them so
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # a word's last token alone has the suffix, for words of letters have none of its signs
        suffix, vocab = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}  # what was known before the parts were too many; what is met again is kept
        self.signs = {s: self._alone(s) for s in ["", *SIGNS]}  # and ends of up to END_SIGNS signs, as they are met

    def _alone(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u2").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(ends * 2).tolist()]
                found.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
            else:
                found.update((w, self._alone(w)) for w in some)
        return found

    def _learn(self, parts: Iterable[str]) -> dict[str, bytes]:
        known = self.known
        # words of letters, and those with signs behind them, as they are and in lower case
        whole = [p for p in parts if p.isalpha() and p.isascii()]
        lows = list(map(str.lower, whole))
        ended, stems, ends, others = [], [], [], []
        for p in parts:
            word = p.rstrip(SIGNS)
            if not word.isalpha() or len(p) - len(word) > END_SIGNS:
                others.append(p)
                continue
            if word.isascii():
                if len(word) == len(p):
                    continue
                low = word.lower()
            else:
                low = "".join(map(str.lower, word))  # letter by letter, as the tokenizer does
                if not low.isalpha() or not (max(word) < COMBINING or unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low)):
                    others.append(p)
                    continue
            end = p[len(word) :]
            if end not in self.signs:
                self.signs[end] = self._alone(end)
            ended.append(p)
            stems.append(low)
            ends.append(self.signs[end])
        found = self._words(list({*lows, *stems}.difference(known)))
        get = lambda low: found[low] if low in found else known[low]
        own = list(map(get, lows))
        found_ended = [get(low) + end for low, end in zip(stems, ends)]
        found.update(zip(whole, own))
        found.update(zip(ended, found_ended))
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            found[p] = np.array(e.ids, "<u2").tobytes()
        return found

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if len(self.known) > CACHE_PARTS // 2:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        unmet = set().union(*parts).difference(known)
        if older:
            new = unmet.difference(older)
            known.update((p, older[p]) for p in unmet.difference(new))
            unmet = new
        new = self._learn(unmet)
        if max(map(len, new), default=0) <= 40:
            known.update(new)
            return [b"".join(map(known.__getitem__, ps)) for ps in parts]
        long = {p: b for p, b in new.items() if len(p) > 40}
        known.update((p, b) for p, b in new.items() if len(p) <= 40)
        return [b"".join([known[p] if p in known else long[p] for p in ps]) for ps in parts]
