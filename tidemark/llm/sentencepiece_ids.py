"""SentencePiece models on the tokenizers library's engine.

The model file's protobuf is parsed and its parts rebuilt: the normaliser (character map, white space rules),
the marker for blanks, unigram scores or BPE merges in order of score, and byte fallback. Batches are encoded
by the library's threads; whether the ids are those of the sentencepiece library itself is verified on every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
#: Characters encoded at a time, parts that are joined, parts that a worker keeps before it starts afresh.
CHUNK, TOGETHER, CACHE_PARTS = 1_000_000, 200, 700_000


def parse(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def merges(pieces: Sequence[tuple[str, float]]) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, the best scored piece first."""
    ids = {p: i for i, (p, _) in enumerate(pieces)}
    found = []
    for piece, score in pieces:
        own = [(ids[piece[:k]], ids[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        found += [(-score, ids[piece], pair) for pair in sorted(own)]
    found.sort(key=lambda t: t[:2])
    return [(pieces[a][0], pieces[b][0]) for _, _, (a, b) in found]


def build(path: str):
    """A tokenizers.Tokenizer that does what the SentencePiece model in path does."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    m = parse(path)
    pieces = [(p.piece, p.score) for p in m.pieces]
    unknown = next((i for i, p in enumerate(m.pieces) if p.type == UNKNOWN), None)
    bytes_too = any(p.type == BYTE for p in m.pieces)
    if m.trainer_spec.model_type == UNIGRAM:
        model = models.Unigram(pieces, unknown, bytes_too)
    elif m.trainer_spec.model_type == BPE:
        normal = [(p.piece, p.score) for p in m.pieces if p.type in (NORMAL, USER_DEFINED)]
        model = models.BPE({p: i for i, (p, _) in enumerate(pieces)}, merges(normal), unk_token=None if unknown is None else pieces[unknown][0], fuse_unk=True, byte_fallback=bytes_too)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    t = Tokenizer(model)
    spec = m.normalizer_spec
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        from tokenizers import Regex

        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    last = [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    t.add_tokens([AddedToken(p.piece, normalized=False) for p in m.pieces if p.type == USER_DEFINED])
    return t


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """The worker's codec: tasks that run in a worker one after another know what those before have met."""
    return Codec(path)


class Codec:
    """Encodes and decodes by the rebuilt tokenizer; keeps the ids of parts between single blanks.

    Parts can be encoded apart only if no piece holds a marker behind other characters, the normaliser
    changes nothing but blanks, and the text has no runs of blanks; else a text is encoded whole. Parts met for
    the first time are joined by blanks, many to a text, and told apart again by the pieces that open with a marker.
    """

    def __init__(self, path: str) -> None:
        m = parse(path)
        self.tokenizer = build(path)
        spec = m.normalizer_spec
        self.apart = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.precompiled_charsmap and not any(MARK in p.piece.lstrip(MARK) or p.type == USER_DEFINED for p in m.pieces)
        self.opens = np.array([p.piece.startswith(MARK) for p in m.pieces])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()  # parts that decoding does not give back

    def _simple(self, text: str) -> bool:
        return bool(self.apart and text and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text)

    def _learn(self, parts: list[str], texts: list[str]) -> tuple[dict[str, bytes], list[np.ndarray]]:
        """The ids of parts, and of whole texts, in one batch."""
        groups = [parts[at : at + TOGETHER] for at in range(0, len(parts), TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast([*map(" ".join, groups), *texts], add_special_tokens=False)
        found: dict[str, bytes] = {}
        joined = [np.array(e.ids, "<u4") for e in encoded]
        for group, ids in zip(groups, joined):
            cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            if len(cuts) != len(group) + 1 or cuts[0]:  # not to be told apart
                own = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
            else:
                raw, ends = ids.tobytes(), (cuts * 4).tolist()
                own = [raw[i:j] for i, j in zip(ends, ends[1:])]
            found.update(zip(group, own))
            if self.decode([ids])[0] != " ".join(group):
                self.odd.update(p for p, back in zip(group, self.decode([np.frombuffer(x, "<u4") for x in own])) if back != p)
        return found, joined[len(groups) :]

    def encode(self, texts: Sequence[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether decoding them gives it back.

        A marker opens each part's ids and bytes of one character are never parted by it, so a text comes back
        if its parts do.
        """
        if len(self.known) > CACHE_PARTS:
            self._forget()
        known = self.known
        parts = [t.split(" ") if self._simple(t) else None for t in texts]
        whole = [i for i, ps in enumerate(parts) if ps is None]
        new, rest = self._learn([p for p in set().union(*filter(None, parts)) if p not in known], [texts[i] for i in whole])
        long = {p: b for p, b in new.items() if len(p) > 40}
        known.update((p, b) for p, b in new.items() if len(p) <= 40)
        ids: list[np.ndarray] = []
        others = iter(rest)
        for ps in parts:
            if ps is None:
                ids.append(next(others))
            elif long:
                ids.append(np.frombuffer(b"".join([known[p] if p in known else long[p] for p in ps]), "<u4"))
            else:
                ids.append(np.frombuffer(b"".join(map(known.__getitem__, ps)), "<u4"))
        back = [not self.odd or self.odd.isdisjoint(ps) if ps else None for ps in parts]
        for i, text in zip(whole, self.decode([ids[i] for i in whole])):
            back[i] = text == texts[i]
        self.odd.difference_update(long)
        return ids, back

    def decode(self, ids: Sequence[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


OUT = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean, ids array<int>"


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_crc32, parity, round_trip, ids.

    parity: the sentencepiece library gives the same ids for the whole text; round_trip: decoding gives the
    text back. Null texts are empty and have no ids. ids_crc32 is that of the ids as unsigned 32-bit
    little-endian numbers. A model that normalises text does not give it back unchanged. Rows stand each for
    itself, whatever their ids; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own, judge = codec(model), sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            doc_ids, texts = b["doc_id"].to_pylist(), [t or "" for t in b["text"].to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size += len(texts[to])
                    to += 1
                part = texts[at:to]
                ids, back = own.encode(part)
                same = [np.array_equal(x, np.array(y, "<u4")) for x, y in zip(ids, judge.encode(part, num_threads=1))]
                cols = [pa.array(doc_ids[at:to], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same), pa.array(back), pa.array([x.tolist() if with_ids else None for x in ids], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in OUT.split(", ")])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)
