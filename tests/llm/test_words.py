"""Words and seeds of many texts at once are those of each by itself."""

import numpy as np
import xxhash

from tidemark.llm import base, substring_dedup

rng = np.random.default_rng(3)
SIGNS = list("abcXYZ019 \t\n\x0b\x1c\x1f\x85\xa0\u3000.,;'\"-_()\x00\u00e9\u00c9\u00df\u00d7\u00f7\u03a3\u03c3\u65e5\u0130\u017fK\u00b2\u0663\u0301")


def plain(text):
    """Word by word, by the hash's own library."""
    parts = ("".join(filter(str.isalnum, p.lower())) for p in (text or "").split())
    return [xxhash.xxh64_intdigest(p) >> 1 | 1 for p in parts if p]


def test_words_of_many_texts_are_hashed_as_one_by_one(monkeypatch):
    texts = ["".join(rng.choice(SIGNS, int(n))) for n in rng.integers(0, 200, 400)]
    texts += [None, "", " ", *("x" * n for n in range(1, 70)), "ab1 " * 9000 + "q", "z" * 50_000, "\u00e9" * 40_000 + " a"]
    for together in (base.TOGETHER, 1000, 40):
        monkeypatch.setattr(base, "TOGETHER", together)
        got = list(base.Words().each(texts))
        assert [w.tolist() for w in got] == [plain(t) for t in texts]


def test_seeds_of_many_texts_are_those_of_each():
    texts = [rng.integers(0, 2**63, int(n)).astype(np.uint64) for n in (0, 3, 6, 10, 16, 17, 18, 40, 0, 500, 5)]
    h, at, numbers = substring_dedup.seeds_of(np.concatenate(texts), np.cumsum([len(t) for t in texts]))
    cuts = np.cumsum(numbers)[:-1]
    for t, own, places in zip(texts, np.split(h, cuts), np.split(at, cuts)):
        shingles = base.shingles(t, substring_dedup.K) if len(t) >= substring_dedup.K else t[:0]
        keys, w = base.mix(shingles) >> np.uint64(24), min(substring_dedup.WINDOW, len(shingles))
        expected = sorted({i + int(keys[i : i + w].argmin()) for i in range(len(shingles) - w + 1)}) if w else []
        assert places.tolist() == expected and own.tolist() == shingles[expected].tolist()


def test_words_in_common_between_gaps():
    for _ in range(200):
        a, b = (rng.integers(0, 6, int(n)).astype(np.uint32) for n in rng.integers(0, 90, 2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert substring_dedup._gap(a, b) == row[-1]


def test_a_worker_lets_go_of_an_encoder_when_another_operator_runs():
    import gc
    import weakref

    from tidemark.llm import tokens, toxicity
    from tidemark.llm.queries import vocabulary

    path = vocabulary("word_bpe_49k.json")
    for other in (base.Words, toxicity.Terms):
        encoder = tokens.part_encoder(path)
        assert tokens.part_encoder(path) is encoder
        seen = weakref.ref(encoder)
        del encoder
        other()
        gc.collect()
        assert seen() is None
