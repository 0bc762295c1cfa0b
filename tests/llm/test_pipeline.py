"""Stages of the corpus pipeline: odd rows, clashing columns, and what each keeps against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import base as base_module
from tidemark.llm import components, exact_dedup, near_dedup, substring_dedup, toxicity

rng = np.random.default_rng(23)
POOL = [f"w{i}" for i in range(4000)]
#: Names that operators use for their own results and helpers.
CLASH = ["kept", "keep_id", "digest", "n", "score", "predicted", "spans", "_id", "_row", "_kept_id", "_passage_doc", "_passage_spans", "root", "key"]
SCHEMA = "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in CLASH)


def words(n):
    return " ".join(rng.choice(POOL, n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), *CLASH) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = words(15_000)
    return table(spark, [(1, None), (2, ""), (3, " \n "), (4, "one"), (6, "Two words"), (6, "Two words"), (5, "Two words"), (None, "Two words"), (None, None), (7, long), (8, long + " end"), (9, "x"), (9, "y"), (12, "y")])


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(4, 0), (5, 0), (7, 0), (99, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_rows_and_empty_tables(spark, odd, sf, name, stage):
    got = stage(spark, odd, sf)
    if name != "packing":
        assert got.columns == odd.columns
    assert got.collect()
    assert stage(spark, odd.where("doc_id > 100"), sf).collect() == []


def test_of_equal_texts_one_row_stays(spark, odd):
    got = rows_of(exact_dedup.unique_rows(odd))
    assert [x for x in got if x[1] == "Two words"] == [(6, "Two words")]
    assert [x for x in got if x[1] in ("x", "y")] == [(12, "y"), (9, "x")]
    assert len(got) == len({t or "" for _, t in rows_of(odd)})


def test_rows_are_kept_by_id(spark, odd):
    decided = spark.createDataFrame([(6, True), (None, True), (9, False)], "doc_id long, kept boolean")
    assert rows_of(exact_dedup.keep_rows(odd, decided)) == sorted([(6, "Two words"), (6, "Two words"), (None, "Two words"), (None, None)], key=str)


def test_passages_are_cut_from_texts_alone(spark, odd):
    found = spark.createDataFrame([(4, 0, 1), (8, 15_000, 1), (77, 0, 5)], "doc_id long, start_word int, n_words int")
    got = {r["doc_id"]: r for r in substring_dedup.remove(odd, found).collect()}
    assert got[4]["text"] == "" and got[4]["n_chars"] == 0 and got[8]["text"].split() == got[7]["text"].split() and got[1]["text"] is None and got[7]["spans"] == "spans"


def test_clean_rows_stay_and_toxic_ones_go(spark):
    rows = [(i, f"{words(15)} {'vile filth' if i % 5 == 0 else ''}", int(i % 5 == 0)) for i in range(400)]
    machine = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    docs = table(spark, [(1, "you vile filth"), (1, words(20)), (None, words(10)), (2, None)])
    assert len(toxicity.keep_clean(docs, machine).collect()) == 3
    scored = {(r["doc_id"], r["predicted"]) for r in toxicity.score(docs, machine).collect()}
    assert (1, 1) in scored and (1, 0) in scored


def test_classify_ignores_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(4, 0, 1.0, "x"), (5, 1, 0.0, "y")], "doc_id long, toxic int, score double, predicted string")
    assert len(toxicity.classify(odd, labels).collect()) == odd.count()


def test_the_pipeline_is_what_its_stages_do(spark, tmp_path):
    """Planted: toxic, exact and near copies, a passage of 70 words in three documents; the rest is kept whole."""
    base, passage = [words(120) for _ in range(30)], words(70)
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(100 + i, base[i]) for i in range(5)]
    docs += [(200 + i, base[10 + i] + " tail") for i in range(5)]
    docs += [(300 + i, f"{words(80)} {passage} {words(80)}") for i in range(3)]
    toxic = [(400 + i, f"{words(30)} vile filth") for i in range(120)]
    clean = [(600 + i, words(30)) for i in range(240)]
    table(spark, docs + toxic + clean).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    kept = {i for i in range(5, 30)} | {100 + i for i in range(5)} | {300, 301, 302} | {i for i, _ in clean}
    assert set(got) == kept
    assert got[300] > 1.3 * max(got[301], got[302])


def test_pairs_of_a_text_that_repeats_itself_meet_as_one_row_for_each_document(spark, monkeypatch):
    quotes = [" ".join(rng.choice(POOL, 30)) for _ in range(4)]
    # first of their own kind in various documents, then many times over in two
    rows = [(i, f"{words(60)} {q} {words(60)}") for i, q in enumerate(quotes)]
    rows += [(i, " ".join(f"{quotes[int(k)]} {words(3)}" for k in rng.integers(0, 4, 60))) for i in (8, 9)]
    met, attach = [], substring_dedup.attach

    def seen(left, groups, key, *args, **named):
        if key == "pair":
            met.append(left.select("doc_id", "pair").toPandas())
        return attach(left, groups, key, *args, **named)

    monkeypatch.setattr(substring_dedup, "attach", seen)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring_dedup.passages(table).count()
    assert len(met) == 1 and len(met[0]) and not met[0].duplicated().any()


def test_small_tables_are_few_files_whatever_the_number_of_partitions(spark, monkeypatch):
    base = [words(120) for _ in range(12)]
    rows = [(i, " ".join(w if (j + i) % 97 else "edit" for j, w in enumerate(base[i % 12].split())) + " " + words(i % 7 * 20)) for i in range(60)]
    files, settings = {}, {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def recorded(df, name, keep=base_module.written):
        out = keep(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    def found():
        docs = table(spark, rows)
        return sorted(tuple(r) for r in near_dedup.dedup(docs).collect()), sorted(tuple(r) for r in substring_dedup.passages(docs).collect())

    wanted = found()
    for module in (near_dedup, components, substring_dedup):
        monkeypatch.setattr(module, "written", recorded)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert found() == wanted
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    del files["links"]  # written where sorted texts meet
    assert {"members", "buckets", "edges", "known", "anchors", "chains", "stretches", "runs"} <= set(files)
    assert max(files.values()) <= 8, files
