"""Alignment of two tokenizers over whole texts, on Arrow's own kernels.

Tokens of a batch of texts are lists; flattened, with the places of their texts beside them, segmented running sums of
their bytes give where in its text each token ends. A hash join on (text, end) finds the tokens of both sides that end
together. Pairs of ids are counted within tasks by grouped tables, and the partial counts are summed by Spark.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import attach, written
from .sentencepiece_ids import BYTE, MARK, parse

#: Characters encoded at a time, parts that a worker keeps of each side, pairs that a task counts before it hands them on.
CHUNK, CACHE_PARTS, PAIRS = 600_000, 200_000, 1_000_000
#: A pair is frequent if it is more than one link in so many: so many pairs at most, of 20 bytes each, are broadcast.
FREQUENT = 50_000
#: Parts that a tokenizer is given at a time.
TOGETHER = 2000
_ENDS = (b",", b"|", b";")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer's ids of a blank and a text, and its tokens' bytes.

    No token spans a blank that stands between two characters other than white space, so the parts between such
    blanks are encoded once; a text with other blanks is encoded whole.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], tokens: list[bytes], apart: bool, mark: str = "") -> None:
        self.encode, self.apart, self.mark = encode, apart, mark
        self.tokens = pa.array(tokens, pa.binary())
        self.blank = np.array([t[:1] == b" " for t in tokens])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before the parts were too many; what is met again is kept

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.encode(texts)] if texts else []

    def _parts(self, parts: list[str]) -> list[bytes]:
        """The same of sound parts: many are encoded as one text and told apart by the tokens that begin with a blank, or each alone if these are not as many."""
        out = []
        for at in range(0, len(parts), TOGETHER):
            some = parts[at : at + TOGETHER]
            raw = array("I", self.encode([" ".join(some)])[0]).tobytes()
            cuts = (np.flatnonzero(self.blank[np.frombuffer(raw, "<u4")]) * 4).tolist()
            if len(cuts) == len(some) and cuts[0] == 0:
                out += [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)])]
            else:
                out += self._ids(some)
        return out

    def _sound(self, parts: list[str]) -> list[str]:
        """Parts that can stand alone: not empty, without white space at their ends and without the mark."""
        found = [p for p in parts if p and p.strip() == p]
        return [p for p in found if self.mark not in p] if self.mark else found

    def __call__(self, texts: Sequence[str], parts: Sequence[list[str]], distinct: set[str]) -> list[bytes]:
        """32-bit ids of each text; an empty text has none. parts: the texts' parts between blanks, distinct: all of them."""
        if len(self.known) > CACHE_PARTS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        unmet = [p for p in distinct if p not in known] if self.apart else []
        if older:
            known.update((p, older[p]) for p in unmet if p in older)
            unmet = [p for p in unmet if p not in known]
        new = self._sound(unmet)
        known.update(zip(new, self._parts(new)))
        out, whole = [], []
        for i, (t, ps) in enumerate(zip(texts, parts)):
            try:
                out.append(b"".join(map(known.__getitem__, ps)) if t else b"")
            except KeyError:  # a part that cannot stand alone
                out.append(b"")
                whole.append(i)
        for p in new:
            if len(p) > 40:
                del known[p]
        for i, x in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = x
        return out


def split(texts: Sequence[str]) -> tuple[list[list[str]], set[str]]:
    parts = [t.split(" ") for t in texts]
    return parts, set().union(*parts)


@lru_cache(maxsize=1)
def byte_level(path: str) -> Side:
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    of = byte_of()
    tokens = [b""] * (1 + max(t.get_vocab().values()))
    for piece, i in t.get_vocab().items():
        tokens[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
    encode = lambda texts: [e.ids for e in t.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
    return Side(encode, tokens, isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and t.pre_tokenizer.use_regex and t.normalizer is None)


@lru_cache(maxsize=1)
def pieces(path: str) -> Side:
    import sentencepiece

    m, judge = parse(path), sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() for p in m.pieces]
    spec = m.normalizer_spec
    apart = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.precompiled_charsmap and not any(MARK in p.piece.lstrip(MARK) for p in m.pieces)
    return Side(lambda texts: judge.encode(texts, num_threads=1), tokens, apart, MARK)


class Flat:
    """Tokens of many texts in one: ids, each one's text, and the place in it where the token ends."""

    def __init__(self, ids: list[bytes], tokens: pa.BinaryArray) -> None:
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
        self.sizes, self.ids, self.text = sizes, pc.list_flatten(lists), pc.list_parent_indices(lists)
        self.bytes = tokens.take(self.ids)
        upto = pc.cumulative_sum(pc.binary_length(self.bytes).cast(pa.int64()))
        bounds = np.append(0, upto.to_numpy())[np.append(0, np.cumsum(sizes))]
        self.bounds = bounds  # of texts, in the bytes of all
        self.ends = pc.subtract(upto, pa.array(bounds[:-1]).take(self.text))

    def joined(self) -> memoryview:
        data = self.bytes.buffers()[2]
        return memoryview(data if data is not None else b"").cast("B")

    def table(self, place: str) -> pa.Table:
        """Each token's key, its text and its end in one number, and its place."""
        key = pc.bit_wise_or(pc.shift_left(self.text.cast(pa.int64()), 40), self.ends)
        return pa.table({"key": key, place: pa.array(np.arange(len(self.ids), dtype=np.int32))})


def alike(flat: Flat, raw: list[bytes]) -> np.ndarray:
    """Whether each text's tokens join to its bytes."""
    sizes = np.array([len(x) for x in raw], np.int64)
    data = flat.joined()
    if np.array_equal(np.diff(flat.bounds), sizes) and data[: flat.bounds[-1]] == b"".join(raw):
        return np.ones(len(raw), bool)
    cuts = flat.bounds.tolist()
    return np.array([data[i:j] == x for i, j, x in zip(cuts, cuts[1:], raw)], bool)


@lru_cache(maxsize=2)
def _decimals(n: int) -> pa.BinaryArray:
    return pa.array([b"%d%s" % (i, end) for end in _ENDS for i in range(n)], pa.binary())


def _digests(a: Flat, b: Flat, i: np.ndarray, j: np.ndarray, n_ids: int) -> tuple[np.ndarray, list[str]]:
    """Groups of each text, and the digest of its groups' ids."""
    # where tokens end together a group ends; tokens before that on both sides are the group's
    last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    last_a[i], last_b[j] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n = int(last_a.sum())
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    order = np.zeros(len(group_a) + len(group_b), np.int64)
    order[np.arange(len(group_a)) + (np.cumsum(in_b) - in_b)[group_a]] = a.ids.to_numpy() + n_ids * last_a
    order[np.arange(len(group_b)) + np.cumsum(in_a)[group_b]] = b.ids.to_numpy() + 2 * n_ids * last_b
    said = _decimals(n_ids).take(pa.array(order))
    upto = np.append(0, np.cumsum(pc.binary_length(said).to_numpy()))
    cuts = upto[np.append(0, np.cumsum(a.sizes + b.sizes))].tolist()
    data = memoryview(said.buffers()[2] or b"").cast("B")
    groups = np.diff(np.append(0, np.cumsum(last_a))[np.append(0, np.cumsum(a.sizes))])
    return groups, [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]


_OUT = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
_SQL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _batch(rows: list, **cells: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cells[n] if isinstance(cells.get(n), pa.Array) else pa.array(cells.get(n, [None] * len(rows)), t) for n, t in _OUT], [n for n, _ in _OUT])


def align_texts(texts: list[str], side_a: Side, side_b: Side) -> tuple[dict, pa.Table]:
    """Columns of each text, its pairs of ids that end together and how often; and the table of (text, a, b, count_all)."""
    raw = [b" " + t.encode() if t else b"" for t in texts]
    parts, distinct = split(texts)
    ids = [side_a(texts, parts, distinct), side_b(texts, parts, distinct)]
    a, b = Flat(ids[0], side_a.tokens), Flat(ids[1], side_b.tokens)
    same = alike(a, raw) & alike(b, raw)
    if not same.all():
        a, b = (Flat([x if s else b"" for x, s in zip(own, same)], side.tokens) for own, side in zip(ids, (side_a, side_b)))
    met = a.table("i").join(b.table("j"), keys="key", join_type="inner", use_threads=False).combine_chunks()
    i, j = met["i"].to_numpy(), met["j"].to_numpy()
    groups, digests = _digests(a, b, i, j, max(len(side_a.tokens), len(side_b.tokens)))
    linked = pa.table({"text": a.text.to_numpy()[i], "a": a.ids.to_numpy()[i], "b": b.ids.to_numpy()[j]})
    links = linked.group_by(["text", "a", "b"], use_threads=False).aggregate([([], "count_all")]).sort_by("text")
    of = links["text"].to_numpy()
    cuts = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))), pa.int32())
    times = links["count_all"].to_numpy()
    pairs = links["a"].to_numpy().astype(np.int64) << 32 | links["b"].to_numpy().astype(np.int64)
    lists = {"pairs": pa.ListArray.from_arrays(cuts, pa.array(pairs)), "times": pa.ListArray.from_arrays(cuts, pa.array(times))}
    n_links = np.bincount(of, weights=times, minlength=len(texts)).astype(np.int64)
    columns = {"n_a": a.sizes, "n_b": b.sizes, "n_groups": groups, "n_links": n_links}
    return {k: pa.array(v, pa.int64()) for k, v in columns.items()} | lists | {"groups_sha256": digests}, links


def aligned(docs: DataFrame, path_a: Callable[[], str], path_b: Callable[[], str]) -> DataFrame:
    """A row per document with its counts, digest, and pairs with their times; and rows without a number, whose pairs a task has counted.

    The paths are asked for where the tokenizers are read, on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        side_a, side_b = byte_level(path_a()), pieces(path_b())
        number, counted, waiting = TaskContext.get().partitionId() << 40, [], 0

        def handed_on() -> pa.RecordBatch:
            whole = pa.concat_tables(counted).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])
            pairs = whole["a"].to_numpy().astype(np.int64) << 32 | whole["b"].to_numpy().astype(np.int64)
            counted.clear()
            one = pa.array([0, len(pairs)], pa.int32())
            return _batch([0], pairs=pa.ListArray.from_arrays(one, pa.array(pairs)), times=pa.ListArray.from_arrays(one, pa.array(whole["n_sum"].to_numpy())))

        for b in batches:
            doc_ids, texts = b["doc_id"].to_pylist(), [t or "" for t in b["text"].to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size += len(texts[to])
                    to += 1
                columns, links = align_texts(texts[at:to], side_a, side_b)
                partial = links.group_by(["a", "b"], use_threads=False).aggregate([("count_all", "sum")]).rename_columns(["a", "b", "n"])
                counted.append(partial)
                waiting += len(partial)
                yield _batch(texts[at:to], row=list(range(number, number + to - at)), doc_id=doc_ids[at:to], **columns)
                number += to - at
                at = to
                if waiting > PAIRS:
                    yield handed_on()
                    waiting = 0
        if counted:
            yield handed_on()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SQL)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair (a's id times 2^32 plus b's), n, best: links of the corpus that hold a pair, and whether its b has no pair with more.

    The most of each b id are as many rows as the second tokenizer has ids, so they are broadcast.
    """
    partial = made.where("row IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = written(partial.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: Callable[[], str], path_b: Callable[[], str]) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers encode a blank and the text, strings of special tokens being plain text. Null and empty texts, and
    those whose tokens do not join to a blank and the text (as when a normaliser takes blanks away), have no tokens:
    numbers 0, digest ''. A long text may give very many pairs; they are summed by text again. Rows stand each for
    itself, whatever their ids; other columns are ignored; an empty table gives no rows.
    """
    made = written(aligned(docs, path_a, path_b), "aligned")
    counts = written(pair_counts(made), "counts")
    own = made.where("row IS NOT NULL")
    links = own.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    known = attach(links, counts, "pair", share=FREQUENT)
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return own.join(sums.hint("merge"), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
