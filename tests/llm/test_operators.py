"""The operators on small tables: brute force, round trips and odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import exact_dedup, fingerprints, html_text, licenses, near_dedup, packing, sentencepiece_ids, substring_dedup, toxicity, warc
from tidemark.llm.base import Words, shingles
from tidemark.llm.components import components
from tidemark.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, keep_id string, n string"
rng = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(3000)]


def words(n):
    return list(rng.choice(VOCABULARY, n))


def table(spark, texts):
    """Odd columns on purpose: names that operators use for their own results."""
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(words(20_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "Two words"), (6, "Two words"), (6, "Two words"), (None, "Two words"), (7, long), (8, long + " end"), (9, "é" * 300), (10, "a" * 50_000), (11, "!!! ***")]
    return table(spark, rows)


OPERATORS = {
    "exact": exact_dedup.dedup,
    "near": near_dedup.dedup,
    "passages": substring_dedup.passages,
    "packing": lambda d: packing.pack(d, vocabulary("word_bpe_49k.json")),
    "fingerprints": fingerprints.fingerprints,
    "licenses": licenses.scan,
    "pieces": lambda d: sentencepiece_ids.encode_documents(d, vocabulary("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_do_not_break(spark, odd, name):
    got = OPERATORS[name](odd).collect()
    if name in ("exact", "near", "fingerprints", "licenses", "pieces"):
        assert len(got) == 13
    if name == "packing":
        assert {r["doc_id"] for r in got} == {*range(1, 12), None}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, odd, name):
    assert OPERATORS[name](odd.where("doc_id > 100")).collect() == []


def test_exact_dedup_keeps_the_largest_id(spark, odd):
    got = {r["doc_id"]: r for r in exact_dedup.dedup(odd).collect()}
    assert got[5]["keep_id"] == 6 and not got[5]["kept"] and got[6]["kept"] and got[5]["group_size"] == 4
    assert got[1]["keep_id"] == 2 and got[2]["text_sha256"] == hashlib.sha256(b"").hexdigest()


def test_retired_digests_are_no_longer_live(spark, odd):
    gone = spark.createDataFrame([(hashlib.sha256(b"Two words").digest(),)], "digest binary")
    got = {r["doc_id"]: r for r in exact_dedup.dedup(odd, gone).collect()}
    assert got[6]["keep_id"] is None and not got[6]["kept"] and got[4]["kept"]


def test_cuckoo_index_grows_and_forgets():
    index = exact_dedup.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.get(k) is None
        index.add(k, [i, 1])
    assert index.resizes and all(index.get(k)[0] == i for i, k in enumerate(keys))
    assert all(index.remove(k) for k in keys[::2]) and not index.remove(keys[0])
    assert all((index.get(k) is None) == (i % 2 == 0) for i, k in enumerate(keys)) and index.n == 1500


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 201), (201, 205)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[205] == 201


def brute_classes(texts):
    w = {i: Words()(t) for i, t in texts}
    df = np.zeros(1 << near_dedup.DF_BITS)
    for x in w.values():
        df += np.bincount((np.unique(shingles(x, 5)) >> np.uint64(48)).astype(int), minlength=len(df))
    idf = np.log1p((len(w) + 1) / (df + 1))
    sets, root = {i: near_dedup.weighted(x, idf) for i, x in w.items()}, {i: i for i in w}
    changed = True
    links = [(a, b) for a in w for b in w if a < b and near_dedup.similarity(sets[a], sets[b]) >= 0.8]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_near_dedup_equals_brute_force_in_a_large_group_of_edited_copies(spark):
    base, texts = words(150), []
    for i in range(120):
        copy = list(base)
        for _ in range(int(rng.integers(0, 7))):
            copy[int(rng.integers(0, len(copy)))] = f"edit{rng.integers(0, 10**9)}"
        texts.append((i, " ".join(copy)))
    texts += [(500 + i, " ".join(words(80))) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.dedup(table(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_samples_agree_as_often_as_sets_are_alike():
    a = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = rng.uniform(0.5, 5, 400)
    b, v = a[60:], w[60:] * 1.1
    s = near_dedup.Sampler()
    s.factors = near_dedup.mix(np.arange(1, 2001, dtype=np.uint64)) | np.uint64(1)
    same = (s.samples(a, w) == s.samples(b, v)).mean()
    assert same == pytest.approx(near_dedup.similarity((a, w), (b, v)), abs=0.05)


def test_passages_shared_by_many_are_found_once_and_fuzzy_ones_too(spark):
    shared, texts = words(70), []
    for i in range(30):
        copy = list(shared)
        if i % 3 == 2:
            copy[20], copy[45] = "changed", "again"
        texts.append((i, " ".join([*words(60), *copy, *words(60)])))
    texts += [(100 + i, " ".join(words(150))) for i in range(10)]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in substring_dedup.passages(docs).collect()}
    assert set(got) == set(range(1, 30))
    assert all(60 <= r["start_word"] + 2 <= 64 and 68 <= r["n_words"] <= 74 for r in got.values())
    left = {r["doc_id"]: r["text"].split() for r in substring_dedup.remove(docs, substring_dedup.passages(docs)).collect()}
    assert len(left) == 40 and len(left[0]) == 190 and all(116 <= len(left[i]) <= 122 for i in range(1, 30)) and len(left[100]) == 150


def test_two_passages_of_one_document_are_found_whatever_lies_between(spark):
    one, two = words(60), words(60)
    texts = [(1, [*one, *words(100), *two]), (2, [*one, *words(100), *two]), (3, [*one, *words(70), *two, *words(90)]), (4, [*words(30), *one, *two])]
    got = {}
    for r in substring_dedup.passages(table(spark, [(i, " ".join(t)) for i, t in texts])).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["n_words"]))
    near = lambda spans, wanted: len(spans) == len(wanted) and all(abs(a - b) <= 3 for s, w in zip(sorted(spans), wanted) for a, b in zip(s, w))
    assert set(got) == {2, 3, 4} and near(got[2], [(0, 60), (160, 60)]) and near(got[3], [(0, 60), (130, 60)]) and near(got[4], [(30, 120)])


def test_exact_repeats_are_found_though_their_seeds_occur_first_elsewhere(spark):
    lines = [words(9) for _ in range(8)]
    texts = [(i, [*words(70), *line, *words(70)]) for i, line in enumerate(lines)]
    passage = sum(lines, [])
    texts += [(100, [*words(40), *passage, *words(40)]), (101, [*words(80), *passage]), (102, [*passage[:50], *words(90)]), (103, [*passage[10:58], *words(90)])]
    got = {r["doc_id"]: r for r in substring_dedup.passages(table(spark, [(i, " ".join(t)) for i, t in texts])).collect()}
    assert set(got) == {101, 102}
    assert (got[101]["start_word"], got[101]["n_words"], got[101]["source_id"], got[101]["source_word"]) == (80, 72, 100, 40)
    assert (got[102]["start_word"], got[102]["n_words"], got[102]["source_id"], got[102]["source_word"]) == (0, 50, 100, 40)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_passages_are_found_though_many_quote_parts_of_them_before(spark, edits):
    passage = words(80)
    quote = lambda i: (i, [*words(30), *passage[i % 75 : i % 75 + 6], *words(30)])
    copy = list(passage)
    for k in range(edits):
        copy[15 + 20 * k] = f"edit{k}"
    texts = [*map(quote, range(75)), (100, [*words(40), *passage, *words(40)]), *map(quote, range(150, 225, 3)), (300, [*words(40), *copy, *words(40)])]
    got = substring_dedup.passages(table(spark, [(i, " ".join(t)) for i, t in texts])).collect()
    assert [r["doc_id"] for r in got] == [300] and abs(got[0]["start_word"] - 40) <= 2 and abs(got[0]["n_words"] - 80) <= 4


def test_every_run_of_fifty_words_that_repeats_is_covered(spark):
    """Brute force: all runs of PASSAGE_WORDS words of all texts."""
    pool = [words(int(n)) for n in rng.integers(5, 90, 12)]
    texts = []
    for i in range(60):
        parts = [pool[int(k)][: int(rng.integers(4, 90))] if rng.random() < 0.5 else words(int(rng.integers(3, 40))) for k in rng.integers(0, len(pool), 6)]
        texts.append((i, sum(parts, [])))
    size, seen, repeated = substring_dedup.PASSAGE_WORDS, {}, set()
    for i, t in texts:
        for at in range(len(t) - size + 1):
            run = tuple(t[at : at + size])
            if seen.setdefault(run, i) != i:
                repeated.update((i, at + k) for k in range(size))
    found = set()
    for r in substring_dedup.passages(table(spark, [(i, " ".join(t)) for i, t in texts])).collect():
        found.update((r["doc_id"], r["start_word"] + k) for k in range(r["n_words"]))
    assert len(repeated) > 500 and repeated <= found


def test_hashes_of_runs_do_not_depend_on_their_place():
    w = rng.integers(0, 2**63, 300).astype(np.uint64)
    w[200:260] = w[10:70]
    h = substring_dedup.run_hashes(w, np.arange(251), 50)
    assert (h[200:211] == h[10:21]).all() and len(np.unique(h)) == 251 - 11


def test_seeds_of_long_texts_are_those_of_their_parts(monkeypatch):
    w = rng.integers(0, 2**63, 5000).astype(np.uint64)
    h, at = substring_dedup.seeds(w)
    monkeypatch.setattr(substring_dedup, "STEP", 700)
    again, places = substring_dedup.seeds(w)
    assert (at == places).all() and (h == again).all()


def test_chains_follow_order_and_break_at_long_gaps():
    x, y = [0, 6, 12, 200, 206], [50, 56, 62, 10, 16]
    assert sorted(substring_dedup.chains(x, y)) == [[0, 1, 2], [3, 4]]


def test_packing_gives_every_id_once(spark):
    from tokenizers import Tokenizer

    texts = [(i, " ".join(words(int(n)))) for i, n in enumerate(rng.integers(0, 3000, 40))]
    rows = packing.pack(table(spark, texts), vocabulary("word_bpe_49k.json")).collect()
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, t in texts:
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum((r["ids"] for r in pieces), []) == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0


def test_the_curve_visits_every_cell_by_single_steps():
    cells = np.array(np.meshgrid(*[range(8)] * 4, indexing="ij")).reshape(4, -1).T
    order = np.argsort(packing.hilbert(cells, 3))
    assert np.abs(np.diff(cells[order], axis=0)).sum(1).max() == 1


def test_fingerprints_see_the_next_document(spark):
    texts = [(i, " ".join(words(int(n)))) for i, n in enumerate(rng.integers(1, 400, 25))]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(table(spark, texts)).collect()}
    for k, (i, t) in enumerate(texts):
        other = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()
    large = [r for i, r in got.items() if r["n_chars"] > 500]
    assert min(r["near_edited"] for r in large) > 0.25 > max(r["near_next"] for r in large)


def test_factorization_machine_learns_a_pair_that_neither_word_tells(spark):
    rows = []
    for i in range(600):
        a, b = i % 2, i // 2 % 2
        rows.append((i, " ".join([*words(12), *["idiot"] * a, *["group"] * b]), int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs)
    score = lambda t: machine.score(toxicity.Terms(machine.places)(t))
    assert score("the idiot group") > 0.7 and max(score("the idiot"), score("the group"), score("")) < 0.5


def test_licenses_are_found_by_exact_containment(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = [(1, " ".join(words(200)) + "\n" + notice + "\n" + " ".join(words(90))), (2, "Released under the MIT License."), (3, " ".join(words(300))), (4, "all rights reserved")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(table(spark, texts)).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["MIT"], 3: [], 4: ["All rights reserved"]}


def test_no_license_is_missed_that_a_scan_of_all_windows_finds(spark):
    scanner = licenses.Scanner()
    texts = []
    for i in range(120):
        parts = [words(int(rng.integers(0, 120)))]
        for k in rng.integers(0, len(licenses.TEMPLATES), int(rng.integers(0, 3))):
            phrase = licenses.TEMPLATES[int(k)][1].split()
            for _ in range(int(rng.integers(0, 2))):
                phrase[int(rng.integers(0, len(phrase)))] = "edited"
            parts += [phrase, words(int(rng.integers(1, 60)))]
        texts.append((i, " ".join(sum(parts, []))))
    got = {r["doc_id"]: set(r["licenses"]) for r in licenses.scan(table(spark, texts)).collect()}
    brute = 0
    for i, t in texts:
        for name, k, _, own in scanner.templates:
            stream = shingles(scanner.words(t), k) if len(t.split()) >= k else np.zeros(0, np.uint64)
            best = max((len(np.intersect1d(stream[at : at + len(own)], own)) / len(own) for at in range(len(stream))), default=0)
            covered = {x for x, *_ in scanner.scan([t])[0]}
            if best >= licenses.CONTAINED:
                brute += 1
                assert got[i] and (name in got[i] or covered == got[i]), (i, name)
    assert brute > 60


def test_fingerprints_are_alike_as_sets_of_features_are(spark):
    """Brute force: features of both texts by the definition, window by window, without filters."""
    texts = [(i, " ".join(words(int(n)))) for i, n in enumerate(rng.integers(60, 300, 12))]
    raw = {i: np.frombuffer(t.encode(), np.uint8) for i, t in texts}
    w = fingerprints.WINDOW

    def entropy(x):
        c = np.bincount(x)
        c = c[c > 0]
        total = int(np.round(c * np.log2(c) * 1024).sum())
        return int(min(max((np.log2(w) - total / (1024 * w)) * fingerprints.CLASSES / np.log2(w), 0), fingerprints.CLASSES))

    classes = {i: [entropy(d[k : k + w]) for k in range(len(d) - w + 1)] for i, d in raw.items()}
    counts = np.bincount(np.concatenate(list(classes.values())), minlength=fingerprints.CLASSES + 1)
    rank = fingerprints.precedence(counts)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(table(spark, texts)).collect()}
    for i, d in raw.items():
        ranks, wins = rank[classes[i]], {}
        for at in range(len(ranks) - fingerprints.NEIGHBOURS + 1):
            best = min(range(at, at + fingerprints.NEIGHBOURS), key=lambda k: (ranks[k], k))
            wins[best] = wins.get(best, 0) + 1
        own = sorted(k for k, n in wins.items() if n >= fingerprints.WINS)
        hashes = fingerprints._hashes(d, np.array(own), w)
        assert got[i]["fingerprint"] == fingerprints.encode(fingerprints.filters(hashes)), i


def test_archives_come_back(spark):
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a b", page), (2, None, page), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", page), (6, "ü", "é" * 80 + "\r\n\r\n" + "z" * 100)] + [(10 + i, "u", f"<html>{i} " + " ".join(words(80))) for i in range(60)]
    got = {r["page_id"]: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1 and got[None]["refers_to"] == 1
    assert {got[i]["record_type"] for i in (1, 3, 4, 5, 6)} == {"response"}
    assert all(r["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() and r["payload_bytes"] == len((h or "").encode()) for i, _, h in rows for r in [got[i]])
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


AWKWARD = ["", " ", "\n", "Don't stop, it's 3.14!", "the-and of/the", "Ünïcödé ÉCOLE straße İstanbul", "e\u0301a\u0301 n\u0303", "日本語 テキスト 😀", "a\tb\r\nc\u00a0d\u2003e", "!!! ... ?!", "word. word, word; word: word! word?",
           "word.. (word) 'word'", "x" * 5000, "MiXeD CaSe WORDS and ﬁgure ﬂow", "\x00 \x7f \u200b", "1 22 333 a1 b2c", "ǅ Ω ß ſ K", "और हिन्दी", "a" * 41 + " " + "B" * 60 + "."]


def test_parts_give_the_ids_of_whole_texts(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.tokens import PartEncoder

    path = vocabulary("word_bpe_49k.json")
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäéñ"), int(n))) for n in rng.integers(1, 14, 3000)]
    texts = [*AWKWARD, *(" ".join(w.title() if rng.random() < 0.2 else w + str(rng.choice(["", ".", ",", "?!"])) for w in rng.choice(letters, 300)) for _ in range(40))]
    own = [np.frombuffer(x, "<u2").tolist() for x in PartEncoder(path).encode(texts)]
    assert own == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_decoded_parts_tell_of_whole_texts():
    own = sentencepiece_ids.codec(vocabulary("piece_bpe_32k.model"))
    for _ in range(2):  # the second time from what is known
        ids, back = own.encode(AWKWARD)
        assert back == [x == y for x, y in zip(own.decode(ids), AWKWARD)]


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_models_are_rebuilt(spark, tmp_path, fallback):
    """A model written by hand: pieces with scores, which the public model lacks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    letters = ["".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(1, 7, 200)]
    lines = [" ".join(rng.choice(letters, 12)) for _ in range(40)]
    made = sentencepiece_model_pb2.ModelProto()
    parts = {*"abcdefgh", "▁", *(f"▁{w[:k]}" for w in letters[:60] for k in range(1, len(w) + 1)), *(w[k:] for w in letters[:60] for k in range(len(w)))}
    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback)]
    for piece, score, kind in [*kinds, *((w, -2.0 - float(rng.random() * 9), 1) for w in sorted(parts))]:
        made.pieces.add(piece=piece, score=score, type=kind)
    made.trainer_spec.model_type, made.trainer_spec.byte_fallback = 1, fallback
    made.normalizer_spec.name = "identity"
    model = str(tmp_path / "m.model")
    (tmp_path / "m.model").write_bytes(made.SerializeToString())
    judge = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = list(enumerate([*lines, "", "  two  blanks ", "zebra ünd ½ ﬁ", "日本 a"]))
    got = {r["doc_id"]: r for r in sentencepiece_ids.encode_documents(table(spark, texts), model).collect()}
    for i, t in texts:
        assert got[i]["ids"] == judge.encode(t) and got[i]["parity"], t


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    texts = [(i, t) for i, t in enumerate(["", " a  b ", "日本語 😀\x00", "a\nb\tc", "x▁y", "aaaa aaaaa", *(" ".join(words(50)) for _ in range(5))])]
    model = vocabulary("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in sentencepiece_ids.encode_documents(table(spark, texts), model).collect()}
    judge = sentencepiece.SentencePieceProcessor(model_file=model)
    for i, t in texts:
        assert got[i]["ids"] == judge.encode(t) and got[i]["parity"] and got[i]["round_trip"] == (t != "x▁y")


def test_main_text_of_awkward_pages(spark):
    page = """<html lang=en><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1>
      <p><b>One   two<br>three.<p>Four &lt;five&gt;</p><div class="ad">Buy</div><section class="comments"><p>A reader's comment</p></section></article><footer>&copy; x</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "<script>var x = '<p>no</p>'"), (None, "u", "<article>a<p>b</article>")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "A & B\n\nOne two three.\n\nFour <five>", 34), (2, "", 0), (3, "", 0), (3, "", 0), (None, "a\n\nb", 4)], key=str)


STORY = [
    "It was the best of days for the people of the town, and they came out in the morning to see what had been done to the old bridge over the river.",
    "There was nothing left of it but two stones, which lay in the water as if they had been there for a hundred years, and no one could say who had put them there.",
    "An old man, who had been on the bridge when it went down, said that he had heard a sound like that of a bell, and that he would not go there again for all the gold in the world.",
    "Short one.",
    "So they went home, and in the evening there was a meeting in the hall, at which it was said that the bridge would be made new by the end of the year.",
]
PROSE = "".join(f"<p>{p}</p>" for p in STORY)
WANTED = "\n\n".join(STORY)
MENU = "<div><a href=a>Home</a> <a href=b>News</a> <a href=c>About us</a></div><ul><li><a href=d>Sport</a><li><a href=e>Weather today</a></ul>"
FOOT = "<div>All rights kept. <a href=t>Terms</a></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"{MENU}<div>{PROSE}</div>{FOOT}",  # no article: density decides
        f'{MENU}<div class="overflow-hidden"><article>{PROSE}</article></div>{FOOT}',
        f'<!-- {"x" * 5000} --><html lang=en>{MENU}<main><article>{PROSE}</article><aside><p>{STORY[0]}</p></aside></main>{FOOT}',
        f'{MENU}<div>{PROSE}</div><article><h3>Card</h3><p>A teaser of another story.</p></article><article><p>One more card here.</p></article>{FOOT}',
        f'{MENU}<article>{PROSE}</article><article class="comment"><p>{STORY[1]}</p></article><div id=comments><p>{STORY[2]}</p></div>{FOOT}',
        f'{MENU}<article><div class="article-header"></div><section class="search results">{PROSE}</section><ul><li><a href=x>Related story that is about another bridge</a></ul></article>{FOOT}',
        f'{MENU}<article>{PROSE}</article><div hidden><p>{STORY[0]}</p></div><div style="display: none"><p>{STORY[0]}</p></div><form><p>{STORY[2]}</p></form>{FOOT}',
        f'{MENU}<div><p>We use cookies.</p></div><div>{PROSE}</div><div class="cookie-notice"><p>{STORY[3]} {STORY[0]}</p></div>{FOOT}',
    ],
)
def test_main_text_whatever_the_markup(page):
    assert html_text.main_text(page) == WANTED


OPENINGS = ['<div class="has-sidebar">', '<div class="content no-comments">', '<div class="page-header-image">', '<article class="post comments-open">', '<main><div class="post-share-enabled">', '<div class="layout sidebar-right">', '<div id="widget">', '<div class="siteContent isMenuOpen">']


@pytest.mark.parametrize("opening", OPENINGS)
def test_states_and_wide_asides_lose_no_page(opening):
    page = f'{MENU}<div class="cookie-law-info"><p>{STORY[0]}</p></div>{opening}{PROSE}<div class="comments-area"><p>{STORY[1]}</p></div>{"</div></main>" if "main" in opening else "</article>" if "article" in opening else "</div>"}{FOOT}'
    assert html_text.main_text(page) == WANTED


def test_links_around_blocks_are_links():
    card = f'<a href="/x"><div><h3>Another story</h3><p>{STORY[0]}</p></div></a>'
    assert html_text.main_text(f"{MENU}<div>{PROSE}</div><div>{card}{card}</div>{FOOT}") == WANTED
    assert html_text.main_text(f'{MENU}<div><p><a href="/never-closed">here</p></div><div>{PROSE}</div>{FOOT}') == WANTED
    assert html_text.main_text(f"{MENU}<div><a name=top>{PROSE}</a></div>{FOOT}") == WANTED
    assert html_text.main_text(f'<div class="comments"><p>{STORY[0]}</p><p>{STORY[1]}</p></div>') == ""


def test_words_over_many_templates():
    """Recall and precision of words over templates that name and nest the article and its surroundings in many ways."""
    articles = ['<article class="{}">', '<div class="{}">', '<main><div id="{}">', '<section class="{}">', "<td class={}>"]
    names = ["post", "entry-content", "single has-sidebar", "node node--full", "story-body", "no-comments", "header-image-on page"]
    around = [('<div class="{}"><p>' + STORY[1] + "</p></div>").format(n) for n in ("newsletter-signup", "related-posts", "cookie_banner", "advertBox", "social-share-text", "promo", "comment-list")]
    wanted, kept, right = 0, 0, 0
    for a in articles:
        for n in names:
            for k, extra in enumerate(around):
                body = a.format(n if " " not in n or '"' in a else f'"{n}"') + f"<h1>The bridge of the town</h1>{PROSE}"
                page = f"<html lang=en><body>{MENU}{extra if k % 2 else ''}{body}{'' if k % 2 else extra}</body>"
                want, got = Counter(" ".join(["The bridge of the town", *STORY]).split()), Counter(html_text.main_text(page).split())
                wanted, kept, right = wanted + want.total(), kept + got.total(), right + (want & got).total()
    assert right / wanted > 0.99 and right / kept > 0.97, (right / wanted, right / kept)


def test_stop_words_decide_where_no_element_does():
    listing = "<div>" + "".join(f"<p>{' '.join(f'item{i}x{k} 12mm' for k in range(20))}</p>" for i in range(4)) + "</div>"
    assert html_text.main_text(f"{MENU}{listing}<div>{PROSE}</div>{FOOT}") == WANTED
    german = "<p>" + "Und es war der Tag, an dem sie alle auf die Straße gingen, um zu sehen, was aus dem alten Haus geworden war, von dem man so viel gehört hatte, und in dem noch immer ein Licht war. " * 2 + "</p>"
    assert html_text.main_text(f"<html lang=en>{MENU}{german}{FOOT}").startswith("Und es war der Tag")


def test_odd_pages(spark):
    long = "<article>" + PROSE * 3000 + "</article>"
    rows = [(1, "u", long, "t", 5), (1, "u", long, "t", 5), (2, None, "<<<>>> a < b & c &amp; &#x41;", "t", 5), (None, "u", "<p", "t", 5), (3, "u", "</div></article><td>", "t", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = [(r["page_id"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert sorted(got, key=str)[0] == (1, len("\n\n".join([WANTED] * 3000))) and len(got) == 5
    assert html_text.extract(pages.where("page_id > 100")).collect() == []
    assert len(warc.archive_pages(pages).collect()) == 5


def test_toxicity_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, None), (7, 0), (7, 1)], "doc_id long, toxic int")
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(odd.where("doc_id > 100"), labels.where("toxic > 5")).collect() == []


def test_a_text_lies_in_one_place_whatever_is_projected_beside_it():
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 1 << 16, n).astype("<u2").tobytes() for n in (0, 1, 7, 300, 20_000, *rng.integers(0, 900, 400))]
    signs = packing.directions()
    found = packing.project(ids, signs)
    assert found.shape == (len(ids), packing.DIMS) and (found[0] == 0.5).all()
    alone = np.concatenate([packing.project([x], signs) for x in ids])
    assert (found == alone).all()
    some = np.frombuffer(ids[3], "<u2")
    v = np.log1p(np.bincount(some.astype(np.int64) * 0x9E3779B1 // 128 % packing.BUCKETS, minlength=packing.BUCKETS))
    assert np.allclose(found[3], 1 / (1 + np.exp(-1.702 * (v @ signs / np.sqrt(v @ v)))), atol=1e-5)
    assert packing.project([np.full(5000, 9, "<u2").tobytes()], signs).shape == (1, packing.DIMS)
    assert packing.project([], signs).shape == (0, packing.DIMS)


def test_words_with_several_signs_behind_them_are_encoded_as_words_are(monkeypatch):
    from tidemark.llm import tokens

    encoder = tokens.PartEncoder(vocabulary("word_bpe_49k.json"))
    texts = ["Ends%%% end$$ été&& Été!!! a_ b__ c' d'' e's f-. g<| h|>. Ⱥ.. İ.. ΣΑΣ.. É.. x%%%%", " ".join(f"w{c}rd%%" for c in "aeiou")]
    asked = []

    class Library:
        def encode(self, text, **named):
            return whole.encode(text, **named)

        def encode_batch_fast(self, texts, **named):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **named)

    whole, encoder.tokenizer = encoder.tokenizer, Library()
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    assert not {"Ends%%%", "end$$", "été&&", "ward%%"} & set(asked)


def test_matches_of_one_place_are_not_chained(monkeypatch):
    import pyarrow as pa

    asked, chains = [], substring_dedup.chains
    monkeypatch.setattr(substring_dedup, "chains", lambda x, y, *a: asked.append((x, y)) or chains(x, y, *a))
    rows = [(2, 1, 5, 90, 11), (2, 1, 40, 90, 11), (3, 1, 7, 20, 12), (3, 2, 10, 30, 13), (3, 2, 18, 38, 14)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "source_id", "pos", "source_pos", "seed"])
    got = [r for b in substring_dedup._chain(iter([batch])) for r in b.to_pylist() if r["source_id"] is not None]
    assert [(r["doc_id"], r["source_id"], r["xs"], r["ys"]) for r in got] == [(3, 2, [10, 18], [30, 38])]
    assert asked == [([10, 18], [30, 38])]
