"""Repeated passages by collinear chaining.

Seeds are k-word shingles, one from each window of WINDOW (the smallest hash), so a shared run of
K + WINDOW - 1 words shares a seed. Each seed that occurs more than once has an anchor: its first
occurrence, in the document of the smallest id. Other occurrences are matched to the anchor, never to
each other, so the matches are as many as the occurrences. Matches of a document and an anchor document
are chained in order on both sides, with gap costs, through a Fenwick tree; chains are then aligned word
by word and parted where they do not agree, and aligned stretches that adjoin are one passage.

Anchors alone miss passages whose seeds occur first in various other documents, as short quotations. Two steps
find them where no passage covers a stretch of seeds that occur before. Seeds that stand close are paired there,
and each pair is matched to its own first occurrence and chained as single seeds are: a quotation too short to be a
passage seldom holds two. And where PASSAGE_WORDS words have only seeds that occur before, each such run is looked
up by its hash among all places of those seeds, and joined to its first occurrence. An exact repeat has the same
seeds wherever it occurs, so none of PASSAGE_WORDS words is missed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, attach, few, fresh, groups_of, lists, mix, shingles, written

K, WINDOW = 6, 12
#: Cost of a chain for each word between two seeds on either side; a seed is worth K.
GAP = 0.1
#: Words of a chain at least, of a passage at least, share of them that must agree, words between stretches of a passage at most.
CHAIN_WORDS, PASSAGE_WORDS, AGREE, JOIN_WORDS = 12, 50, 0.8, 8
#: Words that an alignment may reach beyond a chain's ends, and mismatches it bears there before it stops.
REACH, DROP = 24, 4
#: Words of a block, the unit in which alignments fetch the words of documents.
BLOCK = 64
#: Words between neighbouring seeds of an open stretch at most, words that it spans at least, seeds that each is paired with.
APART, OPEN_WORDS, NEXT = 36, 24, 3
#: Places of a text whose windows are searched for seeds at a time.
STEP = 1 << 20


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's seeds; fewer words than K have none."""
    return seeds_of(words, np.array([len(words)]))[:2]


def seeds_of(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the seeds of texts, their places in their text, and how many each text has; fewer words than K have none.

    words: those of all texts in a row; ends: where each text's end.
    """
    starts = np.append(0, ends[:-1])
    hashes, places, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(len(ends), np.int64)
    if not len(ends) or len(words) < K:
        return hashes[0], places[0], numbers
    h = shingles(words, K)
    long = np.flatnonzero(ends - starts >= K + WINDOW - 1)
    # windows start where a text has WINDOW shingles from there on
    last = np.zeros(len(words) + 1, np.int64)
    last[starts[long]] += 1
    last[ends[long] - (K + WINDOW - 2)] -= 1
    inside = np.cumsum(last)[: len(h) - WINDOW + 1].astype(bool)
    found = []
    for lo in range(0, len(h) - WINDOW + 1, STEP):
        part = h[lo : lo + STEP + WINDOW - 1]
        key = (mix(part) >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < WINDOW:
            key = np.minimum(key[: len(key) - (WINDOW - span)], key[WINDOW - span :])
        found.append((key[inside[lo : lo + STEP]] & np.uint64((1 << 24) - 1)).astype(np.int64) + lo)
    at = np.concatenate(found) if found else places[0]  # never descends, for keys differ
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    # of a text with fewer shingles the smallest
    few = np.flatnonzero((ends - starts >= K) & (ends - starts < K + WINDOW - 1)).tolist()
    if few:
        at = np.sort(np.append(at, [starts[i] + (mix(h[starts[i] : ends[i] - K + 1]) >> np.uint64(24)).argmin() for i in few]))
    of = np.searchsorted(ends, at, "right")
    return h[at], at - starts[of], np.bincount(of, minlength=len(ends))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def run_hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each place on, whatever stands around them: sums of words times powers, set back to the same power."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(words), _BASE, np.uint64))
        sums = np.append(np.uint64(0), np.cumsum(words * powers))
        back = np.cumprod(np.full(len(words), _INVERSE, np.uint64))
        return mix((sums[at + size] - sums[at]) * back[at])


def chains(x: list[int], y: list[int], same: bool = False) -> list[list[int]]:
    """Chains of matches (indexes, in order), best first; each match is in one chain at most.

    x ascends. A chain ascends strictly on both sides; a step of dx and dy words costs GAP * (dx + dy), so a
    match extends the chain that the Fenwick tree, over ranks of y, shows best among those that end before it.
    """
    n = len(x)
    rank = {v: r for r, v in enumerate(sorted(set(y)), 1)}
    best: list[tuple[float, int]] = [(-1e18, -1)] * (len(rank) + 1)
    score, back = [0.0] * n, [-1] * n
    waiting: list[int] = []  # matches at the same x, not yet in the tree
    for i in range(n):
        if waiting and x[waiting[0]] < x[i]:
            for j in waiting:
                r, entry = rank[y[j]], (score[j] + GAP * (x[j] + y[j]), j)
                while r < len(best):
                    if entry > best[r]:
                        best[r] = entry
                    r += r & -r
            waiting.clear()
        r, top = rank[y[i]] - 1, (-1e18, -1)
        while r > 0:
            if best[r] > top:
                top = best[r]
            r -= r & -r
        gain = top[0] - GAP * (x[i] + y[i])
        if top[1] >= 0 and gain > 0:
            # overlapping seeds count only the words that are new
            new = min(K, x[i] - x[top[1]], y[i] - y[top[1]])
            score[i], back[i] = gain + max(new, GAP * K), top[1]
        else:
            score[i] = float(K)
        waiting.append(i)
    used, found = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            found.append(path[::-1])
    return found


def _gap(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two stretches have in common, in order."""
    if len(a) == len(b):
        same = int((a == b).sum())
        if same == len(a) or len(a) == 1:
            return same
    if not len(a) or not len(b):
        return 0
    # a bit for each word of b, cleared where the common words so far grow
    where: dict[int, int] = {}
    for i, w in enumerate(b.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    row = every = (1 << len(b)) - 1
    for w in a.tolist():
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(b) - row.bit_count()


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words that the ends may grow by, from their inner side, and how many of them agree."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = np.cumsum(a[:n] == b[:n])
    worth = 2 * same - np.arange(1, n + 1)
    over = np.flatnonzero(np.maximum.accumulate(np.maximum(worth, 0)) - worth > DROP)
    worth = worth[: over[0]] if len(over) else worth
    if not len(worth) or worth.max() <= 0:
        return 0, 0
    to = int(worth.argmax())
    return to + 1, int(same[to])


def align(x: list[int], y: list[int], a: np.ndarray, a_from: int, b: np.ndarray, b_from: int) -> list[tuple[int, int, int, int, float]]:
    """Aligned stretches of a chain: start and end on both sides, and the share of words that agree, AGREE at least.

    a holds the document's words from a_from on, b the anchor's from b_from on. A chain that agrees too little is
    parted at its worst gap, and so are its parts; those under CHAIN_WORDS are left out.
    """
    n = len(x)
    agree, off = [K] * n, np.zeros(n, np.int64)  # of each match, with the gap before it: words that agree and that do not
    for i in range(1, n):
        px, py = x[i - 1] + K, y[i - 1] + K
        more = max(x[i] - px, y[i] - py)
        same = _gap(a[px - a_from : max(x[i], px) - a_from], b[py - b_from : max(y[i], py) - b_from]) if more > 0 else 0
        agree[i] = min(K, x[i] - x[i - 1]) + same
        off[i] = max(more - same, abs(x[i] - x[i - 1] - y[i] + y[i - 1]))
    sums = np.cumsum(agree)
    found, parts = [], [(0, n)]
    while parts:
        lo, hi = parts.pop()
        first, last = x[lo], x[hi - 1] + K
        if last - first < CHAIN_WORDS:
            continue
        # the ends may grow as far as the parts beside them
        a_lo, b_lo = (x[lo - 1] + K, y[lo - 1] + K) if lo else (a_from, b_from)
        a_hi, b_hi = (x[hi], y[hi]) if hi < n else (a_from + len(a), b_from + len(b))
        left, l_same = _extend(a[max(a_lo - a_from, 0) : first - a_from][::-1], b[max(b_lo - b_from, 0) : y[lo] - b_from][::-1])
        right, r_same = _extend(a[last - a_from : max(a_hi, last) - a_from], b[y[hi - 1] + K - b_from : max(b_hi, y[hi - 1] + K) - b_from])
        start, end, other, other_end = first - left, last + right, y[lo] - left, y[hi - 1] + K + right
        share = (K + int(sums[hi - 1] - sums[lo]) + l_same + r_same) / max(end - start, other_end - other)
        if share >= AGREE:
            found.append((start, end, other, other_end, share))
        elif hi - lo > 1:
            at = lo + 1 + int(off[lo + 1 : hi].argmax())
            parts += [(lo, at), (at, hi)]
    return sorted(found)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        doc_ids, texts, at = b["doc_id"].to_numpy(zero_copy_only=False), b["text"].to_pylist(), 0
        found = []
        for some in groups_of(texts):
            h, places, numbers = seeds_of(*words.together(some))
            of = np.repeat(np.arange(len(some)), numbers)
            # the first of its kind in its text
            order = np.lexsort((h, of))
            first = np.zeros(len(h), bool)
            first[order] = np.append(True, (h[order[1:]] != h[order[:-1]]) | (of[order[1:]] != of[order[:-1]]))[: len(h)]
            found.append((h.view(np.int64), doc_ids[at : at + len(some)][of], places.astype(np.int32), first))
            at += len(some)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["seed", "doc_id", "pos", "first"])


CHAINS = "doc_id long, source_id long, chain int, xs array<int>, ys array<int>, seeds array<long>"


def candidates(at: dict[int, int]) -> list[tuple[int, int, int]]:
    """Start, end and seed of stretches in which runs of PASSAGE_WORDS words may repeat; at: repeated seeds by place.

    Such a run has a seed among its first WINDOW words and one among its last WINDOW + K - 1, all of its own
    seeds are repeated, and seeds in it are at most WINDOW apart. Each run is in the stretch of its first seed.
    """
    found, last = [], None
    latest = PASSAGE_WORDS - K - WINDOW + 1  # the last seed of a run is so far from its start at least
    places = sorted(at, reverse=True)
    for after, p in zip([None, *places], places):
        if after is None or after - p > WINDOW:
            last = p
        if last >= p + latest - WINDOW + 1:
            found.append((max(p - WINDOW + 1, 0), min(p, last - latest) + PASSAGE_WORDS, at[p]))
    return found


def open_pairs(at: dict[int, int]) -> list[tuple[int, int, int]]:
    """Each seed with the NEXT ones after it, in stretches where they stand close: place of both, and a hash of the pair; at: repeated seeds by place.

    More than one after it, for what is edited in one text may be a repeated seed in the other.
    """
    places, found, start = sorted(at), [], 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] - places[i - 1] > APART:
            own = places[start:i]
            if own[-1] + K - own[0] >= OPEN_WORDS:
                found += [(own[j], own[k], hash((at[own[j]], at[own[k]]))) for j in range(len(own)) for k in range(j + 1, min(j + 1 + NEXT, len(own)))]
            start = i
    return found


CANDIDATES, PAIRS = -1, -2


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of doc_id, source_id: chains of each pair of documents, and rows without a source for a document's candidates and pairs.

    A row's places (pos) are one or, as an array, many; all are matched to its source_pos.
    """
    rows: list[tuple] = []
    pair, xs, ys = None, [], []
    at: dict[int, int] = {}  # seeds of the document

    def close():
        if pair is None:
            return
        if ys[0] == ys[-1] and min(ys) == max(ys):  # matches of one place cannot follow each other
            return
        number = 0
        x, y = map(list, zip(*sorted(zip(xs, ys))))
        for path in chains(x, y):
            if x[path[-1]] + K - x[path[0]] >= CHAIN_WORDS:
                rows.append((*pair, number, [x[i] for i in path], [y[i] for i in path], None))
                number += 1

    def finish():
        """The end of a document."""
        for kind, found in ((CANDIDATES, candidates(at)), (PAIRS, open_pairs(at))):
            if pair is not None and found:
                rows.append((pair[0], None, kind, *map(list, zip(*found))))
        at.clear()

    def out():
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "source_id", "chain", "xs", "ys", "seeds"])
        rows.clear()
        return batch

    for b in batches:
        for d, s, i, j, seed in zip(*(lists(b[c]) for c in ("doc_id", "source_id", "pos", "source_pos", "seed"))):
            if pair != (d, s):
                close()
                if pair is not None and pair[0] != d:
                    finish()
                pair, xs, ys = (d, s), [], []
            if seed is None:  # pairs, which are not asked for again
                xs.extend(i)
                ys.extend([j] * len(i))
            else:
                xs.append(i)
                ys.append(j)
                at[i] = seed
        yield out()
    close()
    finish()
    yield out()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        ids, numbers, held = [], [], []
        for doc_id, own, wanted in zip(b["doc_id"].to_pylist(), words.each(b["text"].to_pylist()), lists(b["blocks"])):
            w = (own >> np.uint64(16)).astype("<u4")
            for k in wanted:
                part = w[k * BLOCK : (k + 1) * BLOCK]
                if len(part):
                    ids.append(doc_id)
                    numbers.append(k)
                    held.append(part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(held, pa.binary())], ["doc_id", "block", "words"])


STRETCHES = "doc_id long, start int, end int, source_id long, source_word int, agree double, seed long, pair long, places array<int>"
PASSAGES = "doc_id long, start_word int, n_words int, source_id long, source_word int, agree double"


def merged(stretches: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, words, source, its place, agreement) from aligned stretches (start, end, source, its start, agreement)."""
    found: list[tuple] = []
    group: list[tuple] = []
    end = 0

    def close():
        if group and end - group[0][0] >= PASSAGE_WORDS:
            longest = max(group, key=lambda t: (t[1] - t[0], -t[2], -t[3]))
            found.append((group[0][0], end - group[0][0], longest[2], longest[3], min(t[4] for t in group)))

    for x in sorted(stretches):
        if group and x[0] > end + JOIN_WORDS:
            close()
            group, end = [], 0
        group.append(x)
        end = max(end, x[1])
    close()
    return found


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of doc_id, source_id, chain, side, block: aligned stretches, and what no passage covers: seeds of candidates, and pairs with all their places in the document.

    A text that repeats itself has few pairs in many places, so that pairs meet as one row for each document.
    """
    rows: list[tuple] = []
    stretches: list[tuple] = []  # of the document
    wanted: list[tuple] = []  # its candidates and pairs
    key, path, sides = None, None, ({}, {})

    def close():
        """The end of a chain."""
        if path is None or not all(sides):
            return
        held = []
        for side in sides:
            numbers = sorted(side)
            held.append((np.concatenate([np.frombuffer(side[k], "<u4") for k in numbers]), numbers[0] * BLOCK))
        (a, a_from), (b, b_from) = held
        for start, end, other, other_end, agree in align(*path, a, a_from, b, b_from):
            if key[0] != key[1] or other_end <= start:
                stretches.append((start, end, key[1], other, agree))

    def finish():
        """The end of a document."""
        if key is not None:
            rows.extend((key[0], *t, None, None, None) for t in stretches)
            spans = [(p[0], p[0] + p[1]) for p in merged(stretches)]
            pairs: dict[int, list[int]] = {}
            asked: set[int] = set()
            for kind, start, end, seed in wanted:
                i = bisect_right(spans, start, key=lambda span: span[0])
                if not i or spans[i - 1][1] < end:
                    if kind == PAIRS:
                        pairs.setdefault(seed, []).append(start)
                    else:
                        asked.add(seed)
            rows.extend((key[0], None, None, None, None, None, seed, None, None) for seed in sorted(asked))
            rows.extend((key[0], None, None, None, None, None, None, pair, sorted(places)) for pair, places in pairs.items())
            stretches.clear()
            wanted.clear()

    def out():
        cols = list(zip(*rows)) or [[]] * 9
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in STRETCHES.split(", ")])
        rows.clear()
        return batch

    for batch in batches:
        columns = (batch[c].to_pylist() if c == "words" else lists(batch[c]) for c in ("doc_id", "source_id", "chain", "side", "block", "words", "xs", "ys", "seeds"))
        for d, s, c, side, block, words, xs, ys, seeds in zip(*columns):
            if key != (d, s, c):
                close()
                if key is not None and key[0] != d:
                    finish()
                key, path, sides = (d, s, c), None, ({}, {})
            if seeds is not None:
                wanted.extend((c, *t) for t in zip(xs, ys, seeds))
            elif xs is not None:
                path = (xs, ys)
            else:
                sides[side][block] = words
        yield out()
    close()
    finish()
    yield out()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and starts of all runs of PASSAGE_WORDS words that start up to WINDOW - 1 words before given places."""
    words = Words()
    for b in batches:
        hashes, ids, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for doc_id, w, places in zip(b["doc_id"].to_pylist(), words.each(b["text"].to_pylist()), lists(b["places"])):
            if len(w) >= PASSAGE_WORDS:
                at = np.unique(np.subtract.outer(np.array(places), np.arange(WINDOW)))
                at = at[(at >= 0) & (at <= len(w) - PASSAGE_WORDS)]
                hashes.append(run_hashes(w, at, PASSAGE_WORDS).view(np.int64))
                ids.append(np.full(len(at), doc_id, np.int64))
                starts.append(at.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (hashes, ids, starts)], ["window", "doc_id", "start"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of doc_id, start: passages, document by document."""
    rows: list[tuple] = []
    doc, stretches, exact = None, [], {}

    def finish():
        rows.extend((doc, *p) for p in merged(stretches))
        stretches.clear()
        exact.clear()

    for batch in batches:
        for d, start, end, source, other, agree in zip(*(lists(batch[c]) for c in ("doc_id", "start", "end", "source_id", "source_word", "agree"))):
            if d != doc:
                finish()
                doc = d
            # runs that overlap on both sides are one stretch
            i = exact.get((source, other - start)) if agree == 1 else None
            if i is not None and start <= stretches[i][1]:
                stretches[i] = (stretches[i][0], max(end, stretches[i][1]), *stretches[i][2:])
            else:
                if agree == 1:
                    exact[source, other - start] = len(stretches)
                stretches.append((start, end, source, other, agree))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names := [c.split()[0] for c in PASSAGES.split(", ")])
        rows.clear()
    finish()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _aligned(texts: DataFrame, matches: DataFrame, places: int) -> DataFrame:
    """Stretches that the chains of matches (doc_id, source_id, pos, source_pos, seed) align, and what no passage of them covers.

    places: how many places of repeated seeds the texts have, by which few tasks do for few of them.
    """
    chained = matches.repartition("doc_id").sortWithinPartitions("doc_id", "source_id").mapInArrow(_chain, CHAINS)
    chained = written(few(chained, places), "chains")

    first, last = (lambda c: F.element_at(c, 1)), (lambda c: F.element_at(c, -1))
    reach = lambda c: F.sequence(
        F.floor(F.greatest(first(c) - REACH, F.lit(0)) / BLOCK).cast("int"), F.floor((last(c) + K + REACH) / BLOCK).cast("int")
    )
    whole = lambda side, who, c: chained.where("source_id IS NOT NULL").select(
        "doc_id", "source_id", "chain", F.lit(side).alias("side"), F.col(who).alias("owner"), F.explode(reach(c)).alias("block")
    )
    wanted = written(whole(0, "doc_id", "xs").unionByName(whole(1, "source_id", "ys")), "wanted")
    # of each document the blocks that are wanted, at most as many as it has
    by_doc = wanted.select(F.col("owner").alias("_id"), "block").distinct().groupBy("_id").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    words = texts.join(by_doc.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "blocks")
    words = written(few(words.mapInArrow(_blocks, "doc_id long, block int, words binary"), places), "blocks").dropDuplicates(["doc_id", "block"])
    words = written(few(words.select(F.col("doc_id").alias("owner"), "block", "words"), places), "words")
    filled = wanted.join(words.hint("merge"), ["owner", "block"]).select("doc_id", "source_id", "chain", "side", "block", "words")
    none = F.lit(None).cast("array<int>")
    filled = filled.withColumns({"xs": none, "ys": none, "seeds": F.lit(None).cast("array<long>")})
    paths = chained.select("doc_id", "source_id", "chain", F.lit(0).alias("side"), F.lit(-1).alias("block"), F.lit(b"").alias("words"), "xs", "ys", "seeds")
    ready = filled.unionByName(paths).repartition("doc_id").sortWithinPartitions("doc_id", "source_id", "chain", "side", "block")
    return written(few(ready.mapInArrow(_align, STRETCHES), places), "stretches")


def passages(docs: DataFrame, within: bool = False) -> DataFrame:
    """Repeated passages of docs (doc_id, text): doc_id, start_word, n_words, source_id, source_word, agree.

    A row says that PASSAGE_WORDS or more words of doc_id, from its start_word-th word on, repeat words of
    documents with smaller ids (with `within`, also earlier words of its own); source_id has the longest stretch of them, from
    source_word on, and agree is the least share of words that agree in any stretch. The first occurrence is
    not listed. Words are runs of letters and digits in lower case. Null and short texts have no passages,
    nor have rows without a doc_id; rows that share a doc_id are searched as one document. Other columns are
    ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    found = written(texts.mapInArrow(_seeds, "seed long, doc_id long, pos int, first boolean"), "seeds")
    anchors = found.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("doc_id").alias("source_id"),
        F.min_by("pos", F.when(F.col("first"), F.col("doc_id"))).alias("source_pos"),
    )
    number = found.count()
    anchors = written(few(anchors.where("n > 1"), number // 2), "anchors")
    repeated = written(few(attach(found.select("seed", "doc_id", "pos"), anchors, "seed").drop("n"), number), "repeated")
    number = repeated.count()
    matches = repeated.where(f"doc_id <> source_id OR pos >= source_pos + {K}" if within else "doc_id <> source_id").select("doc_id", "source_id", "pos", "source_pos", "seed")
    aligned = _aligned(texts, matches, number)

    # pairs of seeds that no passage covers, a row for each document, matched to the first of their kind in another
    pairs = aligned.where("pair IS NOT NULL").select("pair", "doc_id", F.col("places").alias("pos"))
    firsts = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", F.col("pos")[0].alias("pos"))).alias("first"))
    firsts = firsts.where("n > 1").select("pair", "n", F.col("first.doc_id").alias("source_id"), F.col("first.pos").alias("source_pos"))
    firsts = written(few(firsts, NEXT * number), "pair-firsts")
    matches = attach(pairs, firsts, "pair").where("doc_id <> source_id").select("doc_id", "source_id", "pos", "source_pos", F.lit(None).cast("long").alias("seed"))
    further = _aligned(texts, matches, number)

    # runs that no passage covers, by their hashes
    asked = aligned.where("seed IS NOT NULL").select("seed").distinct().join(anchors.select("seed", "n").hint("merge"), "seed")
    asked = written(few(asked, number // 2), "asked")
    places = attach(repeated.select("seed", "doc_id", "pos"), asked, "seed").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("places"))
    runs = texts.join(places.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "places")
    runs = written(few(runs.mapInArrow(_windows, "window long, doc_id long, start int"), number), "runs")
    firsts = runs.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    firsts = firsts.where("n > 1").select("window", "n", F.col("first.doc_id").alias("source_id"), F.col("first.start").alias("source_word"))
    firsts = written(few(firsts, runs.count() // 2), "firsts")
    again = attach(runs, firsts, "window").where(f"doc_id <> source_id OR start >= source_word + {PASSAGE_WORDS}" if within else "doc_id <> source_id")
    again = again.select("doc_id", "start", (F.col("start") + PASSAGE_WORDS).alias("end"), "source_id", "source_word", F.lit(1.0).alias("agree"))
    both = aligned.where("source_id IS NOT NULL").unionByName(further).drop("seed", "pair", "places").unionByName(again)
    return both.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end", "source_id", "source_word").mapInArrow(_merge, PASSAGES)


def _cut(text: str, spans: list[tuple[int, int]], words: Words) -> str:
    """text without the words of spans (start, number), and without the white space before what follows."""
    at = words.places(text)
    parts = [m.span() for m in re.finditer(r"\S+", text)]
    kept, end = [], 0
    for start, n in sorted(spans):
        if start >= len(at):
            continue
        begin = parts[at[start]][0]
        kept.append(text[end:begin])
        stop = at[min(start + n, len(at)) - 1] + 1
        end = parts[stop][0] if stop < len(parts) else len(text)
    kept.append(text[end:])
    return "".join(kept)


def _remove(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            texts = [_cut(t or "", [(s["start_word"], s["n_words"]) for s in spans], words) if spans else t for t, spans in zip(b["text"].to_pylist(), b[column].to_pylist())]
            n = b.schema.get_field_index("text")
            yield b.set_column(n, b.schema.field(n), pa.array(texts, b.schema.field(n).type)).drop_columns([column])

    return run


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the passages cut out of text, all rows kept; n_chars, if there is one, is counted anew where text changed.

    Rows that share a doc_id were searched as one document, and each loses all of its passages that lie within
    it. Rows without a doc_id, null and empty texts stay as they are; other columns are carried, whatever their
    names; an empty table gives no rows.
    """
    mine, column = fresh(docs, "_passage_doc"), fresh(docs, "_passage_spans")
    spans = found.groupBy(F.col("doc_id").alias(mine)).agg(F.collect_set(F.struct("start_word", "n_words")).alias(column))
    joined = docs.join(spans.hint("shuffle_hash"), docs["doc_id"] == F.col(mine), "left").drop(mine)
    touched = joined.where(F.col(column).isNotNull()).mapInArrow(_remove(column), docs.schema)
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.where(F.col(column).isNull()).drop(column).unionByName(touched)
