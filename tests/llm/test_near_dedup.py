"""Near dedup in a large group of edited copies, and rows that repeat an id."""

import numpy as np

from tidemark.llm import components as contraction
from tidemark.llm import near_dedup
from tidemark.llm.base import Words, shingles

rng = np.random.default_rng(11)
DOCS = "doc_id long, text string, root string, n string, key string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DOCS)


def edited(base, edits, tag):
    copy = list(base)
    for _ in range(edits):
        at = int(rng.integers(0, len(copy)))
        kind = int(rng.integers(0, 3))
        if kind == 0:
            copy[at] = f"{tag}x{rng.integers(0, 10**9)}"
        elif kind == 1:
            copy.insert(at, f"{tag}y{rng.integers(0, 10**9)}")
        else:
            del copy[at]
    return " ".join(copy)


def brute_classes(texts):
    """By all pairs; words do not repeat in a text, so that each shingle counts once."""
    ids = [i for i, _ in texts]
    sets = [np.unique(shingles(Words()(t), near_dedup.WORDS)) for _, t in texts]
    df = np.zeros(1 << near_dedup.DF_BITS)
    for h in sets:
        df += np.bincount((h >> np.uint64(48)).astype(int), minlength=len(df))
    idf = np.log1p((len(texts) + 1) / (df + 1))
    names = np.unique(np.concatenate(sets))
    names = names[np.unique(np.concatenate(sets), return_counts=True)[1] > 1]
    has = np.zeros((len(texts), len(names)), np.float32)
    for i, h in enumerate(sets):
        has[i, np.searchsorted(names, h[np.isin(h, names)])] = 1
    weights = np.array([idf[(h >> np.uint64(48)).astype(int)].sum() for h in sets])
    both = (has * idf[(names >> np.uint64(48)).astype(int)].astype(np.float32)) @ has.T
    alike = both / (weights[:, None] + weights[None, :] - both) >= near_dedup.SIMILARITY
    np.fill_diagonal(alike, True)
    label = np.arange(len(texts))
    while True:
        low = np.array([label[row].min() for row in alike])
        if (low == label).all():
            return {i: ids[k] for i, k in zip(ids, label)}
        label = low


def test_a_group_of_thousands_of_edited_copies_equals_all_pairs_with_few_compared(spark, monkeypatch):
    base = [f"b{i}" for i in range(150)]
    texts = [(i, edited(base, int(rng.integers(0, 14)), f"e{i}")) for i in range(2000)]
    texts += [(5000 + i, edited([f"c{i}w{j}" for j in range(80)], 0, "")) for i in range(60)]
    compared, linked = [], near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda pairs, *rest: compared.append(pairs.count()) or linked(pairs, *rest))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.dedup(table(spark, texts)).select("doc_id", "class_id").collect()}
    assert got == brute_classes(texts)
    assert sum(compared) < 20 * len(texts)


def test_copies_that_grow_line_by_line_are_one_class(spark):
    """Each is like the next, the first is unlike the last: a chain that no star holds together."""
    lines = [f"g{i}" for i in range(400)]
    texts = [(i, " ".join(lines[: 60 + 6 * i])) for i in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.dedup(table(spark, texts)).collect()}
    assert got == brute_classes(texts) and set(got.values()) == {0}


def test_rows_that_repeat_an_id_are_one_document(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "pqr")
    texts = [(9, one), (9, two), (9, one), (3, one), (4, two), (5, three), (None, one), (9, None)]
    got = near_dedup.dedup(table(spark, texts)).collect()
    assert len(got) == len(texts)
    nine = {(r["class_id"], r["kept"]) for r in got if r["doc_id"] == 9}
    assert nine in ({(3, False)}, {(4, False)}) and [r["class_id"] for r in got if r["doc_id"] == 5] == [5]


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(contraction, "FEW", 8)
    rounds, kept = [], contraction.written
    monkeypatch.setattr(contraction, "written", lambda df, name: rounds.append(name) or kept(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(600)] + [(2000, 2001)], "a long, b long")
    got = {r["node"]: r["root"] for r in contraction.components(edges).collect()}
    assert all(got[i] == (0 if i <= 600 else 2000) for i in got) and len(got) == 603
    assert rounds.count("least") <= 20


def test_components_of_random_graphs_whether_edges_are_few_or_not(spark, monkeypatch):
    for few in (0, 10**6):
        monkeypatch.setattr(contraction, "FEW", few)
        edges = [(int(a) * 7919 % 1009, int(b) * 7919 % 1009) for a, b in rng.integers(0, 400, (260, 2))]
        label = {v: v for e in edges for v in e if e[0] != e[1]}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                if a != b and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        assert {r["node"]: r["root"] for r in contraction.components(spark.createDataFrame(edges, "a long, b long")).collect()} == label
