"""Mixing sources to target weights, by DataFrame expressions only.

A source's documents, in an order drawn by hash, lie on a line of words that repeats up to MOST times; the source's
target takes the line's beginning, so no word is read an (n+1)th time before all were read n times. The line is cut
into blocks. A splitting tree deals the blocks among output shards: each node's shards are halved and the left half's
blocks are drawn from the node's by a multivariate hypergeometric draw, source by source, so the shards' quotas add up
to every source's blocks exactly. A shard's quota of a source is the next run of that source's blocks in a permuted
order, and a shard is shuffled by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import partitions, written

#: Weights of the sources in order of their names, repeating; times that a source may be read.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block, blocks of a shard.
BLOCK, SHARD = 512, 256
#: Rows of a bucket and buckets of a group of them: the windows of running sums hold no more than about as many rows.
BUCKET, WIDE = 1000, 1000
#: Sources up to which their table, of some 100 bytes a row, is broadcast.
FEW = 50_000
#: Levels of the tree between two rounds of dealing its nodes out.
LEVELS = 5
SPACE = " \t\n\x0b\f\r"
_KEY = ["_void", "_source"]


def words(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    return F.length(F.translate(runs, SPACE, "")).cast("long")


def draw_key(prefix: str, value: Column) -> Column:
    """48 bits from an MD5 sum, which SQL engines have in common."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(prefix), F.coalesce(value.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def before(totals: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, bucket, before: the sum of value over a group's earlier buckets, in two levels."""
    t = totals.withColumn("_wide", F.expr(f"bucket div {WIDE}"))
    earlier = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    wide = t.groupBy(*group, "_wide").agg(F.sum(value).alias("_sum"))
    wide = wide.select(*group, "_wide", F.coalesce(F.sum("_sum").over(earlier(group, "_wide")), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(value).over(earlier([*group, "_wide"], "bucket")), F.lit(0))
    return t.join(wide.hint("merge"), [*group, "_wide"]).select(*group, "bucket", (F.col("_base") + own).alias("before"))


def running(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the exclusive running sum of value in each group by order, whose first column bucket agrees with.

    No window holds a whole group: buckets are summed first, and what lies before each is added to the sums within.
    """
    totals = rows.groupBy(*group, "bucket").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(before(totals, group, "_sum").hint("merge"), [*group, "bucket"])
    return joined.withColumn(name, F.col("before") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("before")


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with places from 0 in an order: within ranges first, then plus the rows of the ranges before."""
    t = written(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "numbered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return t.join(F.broadcast(parts), "_part").withColumn(name, F.col("_base") + own - 1).drop("_part", "_base")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source as it is told apart, size, and what orders and finds a row; the texts are read once, here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("_void"), F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        words(F.col("text")).alias("size"), draw_key("mix:", F.col("doc_id")).alias("_draw"), F.xxhash64(text).alias("_text"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_void, _source, rows, source_size, place, target: sources share all words by weight, none more than most times its size.

    What is above that is shared anew by those that are not there yet; each round of it brings three numbers to the driver.
    """
    s = sizes.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    s = _numbered(s, _KEY, "place")
    weight = F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")]
    s = written(s.withColumn("weight", weight), "sources")
    share, full = 0.0, -1
    while True:
        capped = F.lit(share) * F.col("weight") > most * F.col("source_size") if full >= 0 else F.lit(False)
        row = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, most * F.col("source_size"))).alias("capped"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(capped).alias("n")).first()
        if row["n"] == full or not row["weight"]:
            break
        full, share = row["n"], float((row["all"] or 0) - (row["capped"] or 0)) / float(row["weight"])
    return s.withColumn("target", F.least(F.lit(share) * F.col("weight"), (most * F.col("source_size")).cast("double"))).drop("weight")


#: The largest k whose probability counts lies within so many standard deviations of the mean: less than 1e-20 is beyond.
_REACH = 10


def _hypergeometric(total: str, kind: str, drawn: str, chance: str) -> str:
    """SQL of the number of a kind among those drawn without replacement, by inversion: the first k at which the sum of
    probabilities from the left reaches chance."""
    p = f"named_struct('t', {total}, 'k', {kind}, 'n', {drawn}, 'u', {chance})"
    sd = "sqrt(p.n * (p.k / p.t) * (1 - p.k / p.t) * ((p.t - p.n) / greatest(p.t - 1, 1)))"
    lo = f"greatest(0L, p.n - (p.t - p.k), CAST(floor(p.n * (p.k / p.t) - {_REACH} * {sd}) AS BIGINT) - {_REACH})"
    hi = f"least(p.n, p.k, CAST(ceil(p.n * (p.k / p.t) + {_REACH} * {sd}) AS BIGINT) + {_REACH})"
    # probabilities relative to that of q.lo, by the ratio of neighbours
    step = "((q.k - i) * CAST(q.n - i AS DOUBLE) / ((i + 1) * CAST(q.t - q.k - q.n + i + 1 AS DOUBLE)))"
    whole = f"aggregate(sequence(q.lo, q.hi), named_struct('w', 1D, 's', 0D), (a, i) -> named_struct('w', a.w * {step}, 's', a.s + a.w), a -> a.s)"
    found = (
        f"aggregate(sequence(q.lo, q.hi), named_struct('w', 1D, 's', 0D, 'goal', q.u * {whole}, 'at', -1L), "
        f"(a, i) -> named_struct('w', a.w * {step}, 's', a.s + a.w, 'goal', a.goal, 'at', CASE WHEN a.at < 0 AND a.s + a.w >= a.goal THEN i ELSE a.at END), a -> CASE WHEN a.at < 0 THEN q.hi ELSE a.at END)"
    )
    some = f"transform(array(named_struct('t', p.t, 'k', p.k, 'n', p.n, 'u', p.u, 'lo', {lo}, 'hi', {hi})), q -> {found})[0]"
    return f"transform(array({p}), p -> CASE WHEN p.k = 0 OR p.n = 0 THEN 0L WHEN p.k = p.t THEN p.n WHEN p.n = p.t THEN p.k ELSE {some} END)[0]"


def quotas(sources: DataFrame, blocks: int, shards: int, seed: int = 13) -> DataFrame:
    """shard, place, first, n: the run of each source's permuted blocks that a shard gets. sources: place, blocks.

    A node's row holds a number for each source that has blocks. Shards are as even as whole blocks allow.
    """
    upto = lambda x: f"({blocks}L * ({x}) div {shards}L)"
    nodes = sources.where("blocks > 0").agg(F.sort_array(F.collect_list(F.struct("place", "blocks"))).alias("s"))
    nodes = nodes.selectExpr("0L AS c", f"CAST({shards} AS BIGINT) AS d", "transform(s, x -> x.place) AS places", "transform(s, x -> x.blocks) AS n", "transform(s, x -> 0L) AS first")
    chance = f"(CAST(pmod(xxhash64({seed}, c, d, size(s.left)), 9007199254740992L) AS DOUBLE) + 0.5D) / 9007199254740992D"
    fold = (
        f"aggregate(n, named_struct('left', CAST(array() AS ARRAY<BIGINT>), 'draws', {upto('(c + d) div 2')} - {upto('c')}, 'total', aggregate(n, 0L, (a, x) -> a + x)), "
        f"(s, x) -> transform(array({_hypergeometric('s.total', 'x', 's.draws', chance)}), k -> named_struct('left', concat(s.left, array(k)), 'draws', s.draws - k, 'total', s.total - x))[0], s -> s.left)"
    )
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level and level % LEVELS == 0:
            nodes = nodes.repartition(partitions(sources.sparkSession), "c")
        nodes = nodes.withColumn("left", F.expr(f"CASE WHEN d - c > 1 THEN {fold} END"))
        halves = (
            "CASE WHEN left IS NULL THEN array(named_struct('c', c, 'd', d, 'n', n, 'first', first)) ELSE array("
            "named_struct('c', c, 'd', (c + d) div 2, 'n', left, 'first', first), "
            "named_struct('c', (c + d) div 2, 'd', d, 'n', zip_with(n, left, (x, y) -> x - y), 'first', zip_with(first, left, (x, y) -> x + y))) END"
        )
        nodes = nodes.select("places", F.explode(F.expr(halves)).alias("h")).select("places", "h.c", "h.d", "h.n", "h.first")
    own = nodes.select(F.col("c").alias("shard"), F.explode(F.arrays_zip("places", "n", "first")).alias("q"))
    return own.select("shard", F.col("q.places").alias("place"), F.col("q.first").alias("first"), F.col("q.n").alias("n")).where("n > 0")


def _block_numbers(sources: DataFrame) -> DataFrame:
    """place, block of every block: in two steps, so that a source's blocks are not made in one task."""
    chunk = 10_000
    some = sources.where("blocks > 0").select("place", "blocks", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {chunk})")).alias("_c"))
    some = some.repartition(partitions(sources.sparkSession), "place", "_c")
    return some.select("place", "blocks", F.explode(F.expr(f"sequence(_c * {chunk}, least(blocks, (_c + 1) * {chunk}) - 1)")).alias("block"))


def _plan(docs: DataFrame, weights: tuple[int, ...], most: int, block: int, shard: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of words with the rows on them, the pieces of rows in blocks, and each block's shard."""
    sizes = written(sized(docs), "sizes")
    sources = targets(sizes, weights, most).withColumn("take", F.floor(F.col("target") + F.lit(0.5)).cast("long"))
    sources = written(sources.withColumn("blocks", F.expr(f"(take + {block - 1}) div {block}")), "targets")
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")).first()
    known = F.broadcast(sources) if row["n"] <= FEW else sources.hint("merge")
    rows = sizes.join(known, _KEY).withColumn("bucket", F.expr(f"_draw div (281474976710656L div greatest(1L, rows div {BUCKET}) + 1)"))
    lines = written(running(rows, _KEY, ["_draw", "doc_id", "size", "_text"], "size", "at"), "lines")
    # rows on each reading of the line, cut where blocks end
    read = lines.withColumn("reading", F.explode(F.array(*map(F.lit, range(most))))).withColumn("_from", F.col("at") + F.col("reading") * F.col("source_size"))
    read = read.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("take"))).where("_to > _from")
    cut = read.withColumn("block", F.explode(F.expr(f"sequence(_from div {block}, (_to - 1) div {block})")))
    pieces = cut.withColumns({"start": F.expr(f"greatest(0L, block * {block} - _from)"), "words": F.expr(f"least(_to, (block + 1) * {block}) - greatest(_from, block * {block})")})
    numbers = _block_numbers(sources).withColumns({"_draw": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "place", "block"), 16), "one": F.lit(1).cast("long")})
    numbers = numbers.withColumn("bucket", F.expr(f"_draw div (281474976710656L div greatest(1L, blocks div {BUCKET}) + 1)"))
    permuted = running(numbers, ["place"], ["_draw", "block"], "one", "turn").select("place", "block", "turn")
    dealt = quotas(sources, row["blocks"], max(1, -(-row["blocks"] // shard)), seed)
    turns = dealt.select("shard", "place", F.explode(F.expr("sequence(first, first + n - 1)")).alias("turn"))
    shards = written(permuted.join(turns.hint("merge"), ["place", "turn"]).select("place", "block", "shard"), "shards")
    return lines, pieces, shards


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 13) -> DataFrame:
    """The mix of docs (doc_id, text, source): one row per piece, doc_id, source, reading, start, words, shard, turn, and _text, a hash of its text.

    A piece is the `words` words from the start-th of a document; pieces of a shard are read in order of turn. Null and
    empty texts have no words and no pieces; the null source is the last. Rows that repeat an id are told apart by
    their size and text; equal ones count each. Other columns are ignored; an empty table gives no rows.
    """
    lines, pieces, shards = _plan(docs, weights, most, block, shard, seed)
    drawn = pieces.join(shards.hint("merge"), ["place", "block"])
    turn = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "place", "block"), "place", "block", "reading", "at"))
    return drawn.select("doc_id", F.when(~F.col("_void"), F.col("_source")).alias("source"), "reading", "start", "words", "shard", turn.alias("turn"), "_text")


def texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """shard, turn, doc_id, text of pieces: a document's words are parted once for all its pieces."""
    own = pieces.groupBy("doc_id", "_text").agg(F.collect_list(F.struct("shard", "turn", "start", "words")).alias("_pieces"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_whole")).withColumn("_text", F.xxhash64("_whole"))
    whole = whole.dropDuplicates(["doc_id", "_text"]).withColumn("_words", F.filter(F.split("_whole", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    joined = whole.join(own.hint("merge"), whole["_text"].eqNullSafe(own["_text"]) & whole["doc_id"].eqNullSafe(own["doc_id"]))
    cut = F.expr("transform(_pieces, p -> named_struct('shard', p.shard, 'turn', p.turn, 'text', array_join(slice(_words, CAST(p.start AS INT) + 1, CAST(p.words AS INT)), ' ')))")
    return joined.select(whole["doc_id"], F.explode(cut).alias("p")).select("p.shard", "p.turn", "doc_id", "p.text")


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 13) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: its words, its source's words and target, and the words the mix takes of it, repeats counted.

    What is drawn is summed over the pieces that have a shard. Null and empty texts have size 0 and are not taken.
    """
    lines, pieces, shards = _plan(docs, weights, most, block, shard, seed)
    drawn = pieces.join(shards.hint("merge"), ["place", "block"])
    columns = ["doc_id", "size", "source_size", "target"]
    some = drawn.groupBy("place", "at").agg(*(F.first(c).alias(c) for c in columns), F.sum("words").alias("taken")).select(*columns, "taken")
    none = lines.where("size = 0 OR at >= take").select(*columns, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)
