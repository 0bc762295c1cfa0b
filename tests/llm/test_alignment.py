"""Alignment against a brute-force version that walks the tokens of each text."""

import hashlib
from collections import Counter
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment
from tidemark.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "word", "", None, " leading", "trailing ", "two  blanks", "a\nb \n c", "tab\there and   there", "über Straße naïve café",
    "日本語 のテキスト", "emoji 👩‍👩‍👧 and \U0001f600", "<s> </s> <unk> <|endoftext|> <0x41>", "▁ marks ▁▁ here", "0 12 1234 12345.67", "it's we'll they'd don't", "\x00 control \x1c \x85   x", "a" * 300,
    "é combining", "x 　 y", "\n", " ", "  ", "same text", "same text", "same text again and again", "(\"quotes\") -- and, signs; all: of! them?", "long " + "word " * 3000 + "end",
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(A))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    of = alignment.byte_of()
    made, counts = [], Counter()
    for text in texts:
        a, b = [], []
        if text:
            a = [(i, bytes(of[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            for i in sp.encode(text):
                p = sp.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a = b = []
        ends = lambda tokens: {sum(len(x) for _, x in tokens[: k + 1]): k for k in range(len(tokens))} if len(tokens) < 2000 else _ends(tokens)
        ea, eb = ends(a), ends(b)
        shared, groups, links, i, j = sorted(ea.keys() & eb.keys()), [], [], 0, 0
        for e in shared:
            groups.append(f"{','.join(str(x) for x, _ in a[i : ea[e] + 1])}|{','.join(str(x) for x, _ in b[j : eb[e] + 1])}")
            i, j = ea[e] + 1, eb[e] + 1
            links.append((a[ea[e]][0], b[eb[e]][0]))
        counts.update(links)
        made.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best: dict = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest) for n_a, n_b, n_groups, links, digest in made]


def _ends(tokens):
    out, at = {}, 0
    for k, (_, x) in enumerate(tokens):
        at += len(x)
        out[at] = k
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ours(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "pairs", "n", "pair", "end")}).repartition(3)
    made = alignment.align(docs, partial(vocabulary, A), partial(vocabulary, B))
    assert made.columns == ["doc_id", *COLUMNS]
    return sorted((tuple(r) for r in made.collect()), key=repr)


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 3])
def test_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    ids = [*range(len(TEXTS) - 2), 5, None]  # a repeated id and none
    want = sorted(((i, *x) for i, x in zip(ids, brute(TEXTS))), key=repr)
    assert ours(spark, list(zip(ids, TEXTS))) == want
    assert sum(x[1] > 0 for x in want) > 15


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(docs, brute([r["text"] for r in docs]))), key=repr)
    assert ours(spark, [tuple(r) for r in docs]) == want


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_parts_are_encoded_as_in_their_texts():
    """Ids of awkward texts that are put together from parts are those of the whole."""
    pieces = ["word", "a\nb", "\n", "it's", "'s", "12", ".", "é", " ", "x y", "()", "日本", "\x85z", "\x1c", "", "W'll"]
    texts = [" ".join([a, b, c]) for a in pieces for b in pieces for c in ("end", "'d", "\t")]
    for side in (alignment.byte_level(vocabulary(A)), alignment.pieces(vocabulary(B))):
        whole = [x for x in side._ids(texts)]
        assert side.apart and side(texts, *alignment.split(texts)) == whole


def test_parts_are_encoded_together_with_the_ids_of_each_alone():
    words = ["a", "don't", "韓國", "x\ty", "\U0001F600!", "<s>", "é", "12,5", "zq" * 30] * 700
    for side in (alignment.byte_level(vocabulary(A)), alignment.pieces(vocabulary(B))):
        sizes, encode = [], side.encode
        side.encode = lambda texts: sizes.append(len(texts)) or encode(texts)  # noqa: B023
        try:
            got = side._parts(words)
        finally:
            side.encode = encode
        assert sizes == [1] * -(-len(words) // alignment.TOGETHER)
        assert got == side._ids(words)
    assert side._sound(["", "a", "\ta", "b　", "x▁y", "c\td"]) == ["a", "c\td"]
