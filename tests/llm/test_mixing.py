"""The mix against its DuckDB equivalent, a brute-force draw and odd tables."""

import math
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.queries import SQL

KIND = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def test_hypergeometric_draws_are_inversions(spark):
    def cdf_at(total, kind, drawn, u):
        whole, sofar = math.comb(total, drawn), Fraction(0)
        for k in range(min(kind, drawn) + 1):
            sofar += Fraction(math.comb(kind, k) * math.comb(total - kind, drawn - k), whole)
            if sofar >= Fraction(u):
                return k
        return min(kind, drawn)

    cases = [(t, k, n, u) for t, k, n in [(10, 3, 4), (50, 49, 25), (7, 7, 3), (9, 0, 4), (1000, 300, 500), (300, 2, 299), (64, 32, 1), (2000, 1999, 1000), (5, 2, 0), (5, 2, 5)] for u in (1e-9, 0.1, 0.31, 0.5, 0.77, 0.999999)]
    got = spark.createDataFrame(cases, "t long, k long, n long, u double").select("t", "k", "n", "u", F.expr(mixing._hypergeometric("t", "k", "n", "u")).alias("x")).collect()
    for r in got:
        assert r["x"] == cdf_at(r["t"], r["k"], r["n"], r["u"]), r


def test_quotas_use_every_block_once(spark):
    sources = spark.createDataFrame([(0, 700), (1, 3), (2, 0), (3, 41), (4, 1)], "place long, blocks long")
    got = mixing.quotas(sources, 745, 11).collect()
    for place, blocks in ((0, 700), (1, 3), (3, 41), (4, 1)):
        runs = sorted((r["first"], r["n"]) for r in got if r["place"] == place)
        assert [a for a, _ in runs] == [sum(n for _, n in runs[:i]) for i in range(len(runs))] and sum(n for _, n in runs) == blocks
    assert sorted({r["shard"] for r in got}) == list(range(11))
    assert {sum(r["n"] for r in got if r["shard"] == s) for s in range(11)} <= {67, 68}


def test_means_of_draws(spark):
    """Over many seeds a source's blocks fall to the first of four shards as often as its share says."""
    sources = spark.createDataFrame([(0, 60), (1, 30), (2, 10)], "place long, blocks long").cache()
    first = [{r["place"]: r["n"] for r in mixing.quotas(sources, 100, 4, seed).where("shard = 0").collect()} for seed in range(30)]
    means = [sum(d.get(p, 0) for d in first) / 30 for p in range(3)]
    assert abs(means[0] - 15) < 2 and abs(means[1] - 7.5) < 1.6 and abs(means[2] - 2.5) < 1.2


ROWS = [
    *[(i, "w " * (i % 40 + 1), "en", "a", 0) for i in range(100, 220)],
    *[(i, f"x\t{i}\x0b y\n" * 7, "en", "b", 0) for i in range(300, 310)],
    (1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, " \n ", None, None, 0), (4, "null source has words", None, None, 0), (5, "long " * 5000, "en", "c", 0),
    (7, "twice the same", "en", "a", 0), (7, "twice the same", "en", "a", 0), (8, "same id", "en", "a", 0), (8, "same id but other text", "en", "a", 0), (None, "no id here", "en", "b", 0),
    (9, "é ü ß  word", "de", "Z", 0), (10, "only in a small one", "de", "ä", 0),
]


def duck(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op13_hypergeometric_mix']})").fetchall(), key=repr)


def rounded(rows):
    return sorted([(*r[:3], round(r[3], 6), r[4]) for r in rows], key=repr)


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None, None, None)], [(1, "one", "en", "s", 3)]])
def test_mix_of_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("size", "target", "place", "bucket", "block", "_draw")})
    got = [tuple(r) for r in mixing.taken(docs, block=16, shard=4).select(COLUMNS).collect()]
    assert rounded(got) == rounded(duck(rows))
    assert all(r[4] <= 3 * r[1] for r in got)


def test_pieces_and_their_texts(spark):
    docs = spark.createDataFrame(ROWS, KIND)
    pieces = mixing.mix(docs, block=16, shard=4).cache()
    rows = pieces.collect()
    assert sum(r["words"] for r in rows) == sum(r[4] for r in duck(ROWS))
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["turn"] for r in rows if r["shard"] == shard) == list(range(1, 1 + sum(r["shard"] == shard for r in rows)))
    words = {(r["shard"], r["turn"]): r["text"].split(" ") for r in mixing.texts(docs, pieces).collect()}
    assert len(words) == len(rows) and all(len(words[(r["shard"], r["turn"])]) == r["words"] for r in rows)
    long = sorted((r["reading"], r["start"], r["words"]) for r in rows if r["doc_id"] == 5)
    for reading in {x[0] for x in long}:  # pieces of a document adjoin
        own = [x[1:] for x in long if x[0] == reading]
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:]))
