"""Operators on small tables: brute force, round trips, and the awkward rows (null, empty, long, repeated, none)."""

import collections
import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from priorform.llm import _common, bpe, jaccard, langid, licenses, mil, nndescent, pitman, shards, winnow, wordpiece
from priorform.llm._common import LOWER, word_hashes
from priorform.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, score string, n_tokens string, e string, k string"
LONG = "lorem ipsum dolor " * 6000 + "sit" * 5000


def make(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i), (sources or {}).get(i), "x", "y", "z", "w") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "two words"), (6, LONG), (7, "same text here again"), (7, "same text here again"),
           (8, "same text here again"), (None, "no id at all"), (9, "12 34 !!"), (10, "Ünïcode ßtraße 漢字 😀  end")]


@pytest.fixture(scope="module")
def awkward(spark):
    return make(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return make(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- language ---------------------------------------------------------------------------------------------------------


def test_language_tables_hold_one_matrix_each(spark):
    """A worker holds the model without an array object per entry; words met later get rows of one matrix as well."""
    model = langid.train(make(spark, [(1, "the cat and the dog"), (2, "der hund")], {1: "en", 2: "de"}))
    assert [t.rows.shape for t in model.tables] == [(len(t), 2) for t in model.tables] and len(model.tables[0]) == 6
    memory = {}
    assert model.predict(["the cat", None, "hund xx", "zzz the"], memory)[0] == ["en", "und", "de", "en"]
    assert memory["filled"] == 4 and memory["rows"].shape == (1024, 2) and not memory["rows"][0].any()


def test_language_backs_off_to_shorter_grams(spark):
    texts = [(1, "the cat and the dog"), (2, "der hund und die katze"), (3, "le chat et le chien")]
    model = langid.train(make(spark, texts, {1: "en", 2: "de", 3: "fr"}))
    assert model.languages == ["de", "en", "fr"]
    assert model.tables[0]["the"][1] == pytest.approx(math.log10(2 / 5))
    unseen = model.word_scores("hunde")  # no word, but its 5-grams " hund" and so on
    grams = [g for g in langid.grams_of("hunde", 5) if g in model.tables[5]]
    assert grams and unseen == pytest.approx(np.mean([model.tables[5][g] for g in grams], axis=0))
    assert model.word_scores("☃") is None
    labels, scores = model.predict(["the the", "hund", "qqq", None, "12 ?!"])
    assert labels[:2] == ["en", "de"] and labels[3:] == ["und", "und"] and scores[3:] == [0, 0]
    assert all(0 <= s <= 1 for s in scores)
    assert scores[2] == pytest.approx(1 / 3) and labels[2] == "de"  # nothing known: the first name, an even share


def test_language_of_awkward_rows(spark, awkward, nothing):
    model = langid.train(make(spark, [(1, "same text here"), (2, "andere worte")], {1: "en", 2: "de"}))
    rows = langid.identify(awkward, model, keep=["doc_id"]).collect()
    assert len(rows) == len(AWKWARD)
    got = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [got[i] for i in (1, 2, 3, 9)] == ["und"] * 4 and got[7] == "en"
    kept = langid.identify(awkward, model)
    assert kept.columns == [c for c in awkward.columns if c != "score"] + ["lang_pred", "score"]
    assert langid.identify(nothing, langid.train(nothing)).count() == 0
    odd = make(spark, [(1, "½ ² Ⅷ"), (2, "½same"), (3, "漢字"), (4, "text ☃")])
    judged = {r["doc_id"]: (r["a"], r["c"]) for r in langid.identify(odd, model, keep=["doc_id"], into=("a", "b", "c")).collect()}
    assert judged == {1: ("und", False), 2: ("en", True), 3: ("de", False), 4: ("en", True)}
    assert {r["lang_pred"] for r in langid.identify(awkward, langid.train(nothing)).collect()} == {"und"}


# --- Jaccard ----------------------------------------------------------------------------------------------------------


def brute_groups(texts, width, percent):
    sets = []
    for _, t in texts:
        w = (t or "").encode().translate(LOWER).split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
            old = group[j]
            group = [group[i] if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, texts):
        least[g] = i if least.get(g) is None else min(x for x in (least[g], i) if x is not None)
    return sorted((i, len(s), least[g] if least[g] is not None else i) for (i, _), s, g in zip(texts, sets, group) if i is not None)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_groups_are_those_of_all_pairs(spark, width, percent):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = [(i, t) for i, t in AWKWARD if i is not None]
    for i in range(100, 112):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 11, 30, 70, 150]))] + passage[: rng.choice([0, 0, 40])]
        for j in range(8):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append((100 * i + j, " ".join(words)))
    for star_rounds in (4, 0):  # without stars all links come from the step that lists pairs
        got = jaccard.link(make(spark, texts), width=width, percent=percent, star_rounds=star_rounds)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == brute_groups(texts, width, percent)


@pytest.mark.parametrize("width,percent,sizes", [(3, 90, (9, 10)), (5, 80, (4, 5))])
def test_jaccard_links_small_sets_inside_larger_ones(spark, width, percent, sizes):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(30)] + [f"x{i}" for i in range(5000)]  # frequent and rare words
    texts = []
    for i in range(20):
        words = [rng.choice(vocabulary[:30] if i % 2 else vocabulary) for _ in range(sizes[1] + width - 1)]
        cut = words[1:] if i % 3 == 0 else words[:-1]
        texts += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(cut)), (10 * i + 2, " ".join(cut[1:]))]
    got = jaccard.link(make(spark, texts), width=width, percent=percent)
    rows = sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect())
    assert rows == brute_groups(texts, width, percent)


@pytest.mark.parametrize("percent", [80, 85, 90, 95])
def test_sets_share_index_entries_with_their_subsets(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for n in range(2, 45):
        for _ in range(12):
            levels = rng.choice(np.array([0, 3, 8, 10, 14, 20], np.uint8), 1 << 12, p=rng.dirichlet(np.ones(6)))
            levels = np.repeat(levels, 1 << (jaccard.CELLS - 12))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            for out in range(1, n):
                b = np.sort(rng.permutation(a)[out:])
                if 100 * len(b) < percent * len(a):
                    break
                shared = np.intersect1d(jaccard.index_entries(a, levels, percent), jaccard.index_entries(b, levels, percent))
                assert len(shared) >= max(jaccard.shared_least(len(x), percent) for x in (a, b)), (len(a), len(b))
                met += 1
    assert met > 100


def test_words_are_hashed_by_batches_of_texts():
    texts = [None, b"", b" \n", b"Abc abd\x0babc", "\u00dcber \u00fcber".encode(), b"a" * 64 + b" " + b"A" * 65 + b" " + b"a" * 65, b"ab ba b"] + [b"x%d y" % i for i in range(200)]
    words = [(t or b"").translate(LOWER).split() for t in texts]
    hashes = [*word_hashes(texts)]
    assert [len(h) for h in hashes] == [len(w) for w in words]
    pairs = {(w, int(h)) for ws, hs in zip(words, hashes) for w, h in zip(ws, hs)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert [x.tolist() for x in jaccard.shingles(texts, 3)] == [x.tolist() for t in texts for x in jaccard.shingles([t], 3)]


def test_jaccard_awkward_rows(spark, awkward, nothing):
    got = jaccard.link(awkward)
    assert got.count() == len(AWKWARD) and jaccard.link(nothing).count() == 0
    rows = by_id(got)
    assert [rows[i]["n_shingles"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert rows[8]["component_id"] == 7 and rows[2]["component_id"] == 2 and rows[None]["component_id"] is None
    with pytest.raises(ValueError):
        jaccard.link(awkward, percent=70)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_enough_index_entries_whatever_the_classes(percent):
    rng = np.random.default_rng(percent)
    for n in (5, 7, 10, 12, 15, 16, 17, 40, 63, 64, 70, 255, 300, 1100):
        for _ in range(6):
            levels = rng.choice(np.array([0, 3, 8, 10, 14, 20], np.uint8), 1 << jaccard.CELLS, p=rng.dirichlet(np.ones(6)))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            out = int(len(a) * (1 - percent / 100) / 2)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[out:]], rng.integers(0, 1 << 63, out).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
            common = len(np.intersect1d(a, b))
            if out and 100 * common >= percent * (len(a) + len(b) - common):
                shared = np.intersect1d(jaccard.index_entries(a, levels, percent), jaccard.index_entries(b, levels, percent))
                assert len(shared) >= max(jaccard.shared_least(len(x), percent) for x in (a, b))


def test_packed_counts_hold_all_counts_in_few_bytes():
    counts = np.zeros(jaccard.BLOCK, np.uint32)
    counts[[3, 9, 77, 500, jaccard.BLOCK - 1]] = [1, 254, 255, 256, 4_000_000_000]
    assert (jaccard.unpacked(jaccard.packed(counts)) == counts).all()
    assert (jaccard.unpacked(jaccard.packed(counts * 0)) == 0).all()


def test_index_entries_stay_in_proportion_for_frequent_tokens():
    tokens = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    for level in (0, 9, 20):
        levels = np.full(1 << jaccard.CELLS, level, np.uint8)
        assert len(jaccard.index_entries(tokens, levels, 90)) < 2 * len(tokens)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 60)] + [(200, 200), (300, 301), (301, 300)]
    rng = random.Random(3)
    rng.shuffle(edges)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1, 60)} == {1} and got[301] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- licences ---------------------------------------------------------------------------------------------------------


def test_license_places_and_key_phrases(spark, awkward, nothing):
    mit = "Permission is hereby granted, free OF charges, to any person obtaining a copy of this software"
    texts = [(1, "x Under the MIT-License! under the mit license"), (2, "the mit license under"), (3, mit), (4, "cc by nc cc by nc-sa"),
             (5, mit.replace("obtaining", "getting")), (6, "unKer the mit license"), (7, "Apache License, Version 2.0 (c) all rights reserved")]
    rows = by_id(licenses.scan(make(spark, texts)))
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["base_labels"], rows[1]["score"]) == (2, 1, 5, "mit", 1.0)
    assert rows[2]["n_base"] == 0 and rows[2]["first_word"] is None and rows[2]["score"] == 0
    assert (rows[3]["base_labels"], rows[3]["labels"], rows[3]["n_base"]) == ("", "mit", 0) and 0.9 < rows[3]["score"] < 1
    assert (rows[4]["n_base"], rows[4]["labels"]) == (2, "cc-by-nc")
    assert rows[5]["labels"] == "" and rows[6]["n_base"] == 0
    assert rows[7]["labels"] == "all-rights-reserved,apache-2" and rows[7]["base_labels"] == "apache-2"
    assert licenses.scan(nothing).count() == 0
    got = licenses.scan(awkward)
    assert got.count() == len(AWKWARD) and by_id(got)[6]["n_words"] == 18001 and by_id(got)[1]["n_words"] == 0


# --- word pieces ------------------------------------------------------------------------------------------------------


def greedy(word, first, inner):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (inner if at else first)), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_counts_like_the_greedy_match():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    for _ in range(150):
        first, inner = {word(5) for _ in range(rng.randint(1, 9))}, {word(4) for _ in range(rng.randint(0, 9))}
        machine = wordpiece.Automaton(first, inner)
        for w in (word(14) for _ in range(60)):
            assert machine.count(w) == greedy(w, first, inner)


def test_token_counts_of_rows(spark, awkward, nothing):
    first, inner = wordpiece.split_vocabulary(["▁same", "▁te", "xt", "▁here", "▁", "▁a", "gain"])
    rows = by_id(wordpiece.counts(awkward, first, inner))
    assert tuple(rows[7])[1:] == (4, 6, 0) and tuple(rows[1])[1:] == (0, 0, 0) and tuple(rows[4])[1:] == (1, 1, 1)
    assert wordpiece.counts(nothing, first, inner).count() == 0
    assert wordpiece.counts(awkward, set(), set()).count() == len(AWKWARD)


# --- quality ----------------------------------------------------------------------------------------------------------


def test_quality_learns_from_document_labels(spark, awkward, nothing):
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice(["river", "Stone", "walks", "bread", "light", "slowly."]) for _ in range(200))
    junk = lambda: clean()[:400] + " " + " ".join(["BUY!!", "NOW!!"] * 80)  # noqa: E731  junk in some passages only
    texts = [(i, clean() if i % 2 else junk()) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(5, None), (None, 1)], "doc_id bigint, quality int")
    docs = make(spark, texts)
    model = mil.train(docs, labels, epochs=25)
    rows = by_id(mil.score(docs, model, keep=["doc_id"]))
    assert all((rows[i]["score"] >= 0.7) == bool(i % 2) for i in range(80, 120))
    got = mil.score(awkward, model)
    assert got.count() == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got.collect())
    assert mil.score(nothing, model).count() == 0 and mil.train(nothing, labels) is None
    assert {r["score"] for r in mil.score(awkward, None).collect()} == {0.5}


def test_attention_gradient_matches_differences():
    rng = np.random.default_rng(2)
    x, counts, y = rng.normal(size=(9, 5)), np.array([2, 3, 1, 3]), np.array([1, 0, 1, 0])
    slow = mil.fit(x, counts, y, 10, epochs=1, bags=4, rate=1e-9)
    fast = mil.fit(x, counts, y, 10, epochs=300, bags=4)
    loss = lambda m: -np.mean(np.log(np.where(y == 1, m.scores(x, counts), 1 - m.scores(x, counts))))
    assert loss(fast) < 0.2 * loss(slow)


# --- shards -----------------------------------------------------------------------------------------------------------


def test_shards_match_the_mixture(spark, awkward, nothing):
    sources = {i: "big" if i % 3 else "small" if i % 6 else None for i in range(600)}
    docs = make(spark, [(i, f"t{i}") for i in range(600)], sources=sources)
    rows = shards.interleave(docs, 7, seed=1, rows_per_cell=16).collect()
    count = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == 600 and max(count.values()) - min(count.values()) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s]))
        share = collections.Counter(sources[r["doc_id"]] for r in rows if r["shard"] == s)
        assert all(abs(share[k] - count[s] * n / 600) <= 2 for k, n in collections.Counter(sources.values()).items())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.interleave(docs.repartition(3), 7, seed=1, rows_per_cell=1000).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}  # the grid does not matter
    got = shards.interleave(awkward, 8).collect()
    assert len(got) == len(AWKWARD) and shards.interleave(nothing, 8).count() == 0
    for r in got:
        text = (dict(AWKWARD)[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))


# --- decontamination --------------------------------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    w, hit, found = winnow.words_of(text and text.encode()), set(), set()
    for item, t in items:
        x = winnow.words_of(t and t.encode())
        n = min(window, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[i : i + n]:
                    hit |= {*range(p, p + n)}
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_winnowing_misses_no_window(spark, awkward, nothing):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefg")
    items = [(f"i{k}", " ".join(word() for _ in range(n))) for k, n in enumerate([30, 12, 10, 9, 3, 25])] + [("none", None), ("copy", None), ("blank", " .,")]
    items[7] = ("copy", items[0][1])
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(40)]
    for i in range(40, 60):
        source = rng.choice(items[:6])[1].split()
        at = rng.randrange(len(source))
        texts.append((i, " ".join([word() for _ in range(20)] + source[at : at + rng.randint(8, 30)] + [word() for _ in range(5)]).upper()))
    bench = spark.createDataFrame(items, "item_id string, text string")
    for r in winnow.report(make(spark, texts), bench).collect():
        n, hit, found = brute_hits(dict(texts)[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, found, hit > 0), r["doc_id"]
    assert winnow.report(nothing, bench).count() == 0
    rows = winnow.report(awkward, spark.createDataFrame([("q", "same TEXT, here again"), ("r", "")], "item_id string, text string")).collect()
    assert len(rows) == len(AWKWARD)
    assert [(r["n_hit"], r["n_items"]) for r in rows if r["doc_id"] in (7, 8)] == [(4, 1)] * 3
    none = winnow.report(awkward, bench.where("1 = 0"))
    assert none.where("contaminated").count() == 0 and none.count() == len(AWKWARD)


# --- language model ---------------------------------------------------------------------------------------------------


def test_seating_has_the_distribution_of_one_by_one():
    rng = np.random.default_rng(6)
    for c, base, others in ((20, 0.1, 30), (60, 0.01, 50), (900, 0.002, 400), (900, 0.99, 5)):
        m = 3000
        entries = np.full(m, c), np.full(m, base), np.full(m, others), 1.0, 0.6
        t = np.ones(m)
        for n in range(1, c):
            a = (1 + 0.6 * (others + t)) * base
            t += rng.random(m) * (n - 0.6 * t + a) < a
        for got in (pitman.seat(*entries, lambda s, w: rng.random(len(w))), pitman.seat_in_turns(*entries, rng)):
            assert abs(got.mean() - t.mean()) < 5 * t.std() * math.sqrt(2 / m) and abs(got.std() - t.std()) < 0.1 * t.std() + 0.02


def test_log_gamma():
    x = np.array([0.05, 0.7, 3.0, 7.99, 8.0, 123.4, 1e7])
    assert pitman.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-8)


def test_context_probabilities_add_up():
    counts = np.random.default_rng(1).poisson(3, (5, 9)) * (np.random.default_rng(2).random((5, 9)) > 0.4)
    counts[3] = 0
    p = pitman.sample_contexts(counts, np.full(9, 1 / 9), burn_in=2, samples=3, theta=1.0, seed=1)
    assert p.sum(axis=1) == pytest.approx(np.ones(6)) and (p > 0).all()
    assert p[3] == pytest.approx(p[5])  # a context without customers is its parent


def test_model_probabilities_of_all_words_add_up(spark):
    rng = random.Random(7)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(500)]
    train = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)]
    words = sorted({w for _, t in train for w in t.split()}) + ["neverseen"]
    asked = [(1000 + i, w) for i, w in enumerate(words)] + [(999, "")]
    docs = make(spark, train + asked)
    rows = by_id(pitman.score(docs, docs["doc_id"] < 999, context=0.02, dish=0.01, head=0.004))
    assert len(rows) == len(train) + len(asked)
    total = sum(10 ** rows[1000 + i]["base_score"] for i in range(len(words))) / 10 ** rows[999]["base_score"]
    assert total + 10 ** rows[999]["base_score"] == pytest.approx(1.0, rel=1e-9)
    first = sum(10 ** rows[1000 + i]["score"] for i in range(len(words))) + 10 ** rows[999]["score"]
    assert 0 < first <= 1  # texts of no or one word are some of all texts


def test_model_knows_all_pairs_as_one_process_does(spark):
    """Whatever ``context`` and ``dish`` say: words below ``head`` and their pairs count, as in counts held whole."""
    rng = random.Random(3)
    after = {w: [rng.randrange(80) for _ in range(3)] for w in range(80)}

    def text(w):
        words = [w]
        for _ in range(30):
            words.append(rng.choice(after[words[-1]]) if rng.random() < 0.8 else int(rng.paretovariate(0.7)) % 80)
        return " ".join(f"w{x}" for x in words)

    texts = [(i, text(rng.randrange(80))) for i in range(140)]
    docs = make(spark, texts)
    rows = by_id(pitman.score(docs, docs["doc_id"] < 100, context=1.0, dish=1.0, head=0.015))
    lists = {i: [*t.split(), None] for i, t in texts}
    number = {w: n for n, w in enumerate(sorted({w for i in range(100) for w in lists[i]}, key=str))}
    start = len(number)
    pairs = lambda i: [(start if u is None else number[u], number[w]) for u, w in zip([None, *lists[i]], lists[i])]
    counts = np.zeros((start + 1, start), np.int64)
    for i in range(100):
        np.add.at(counts, tuple(zip(*pairs(i))), 1)
    p = pitman.sample_contexts(counts, np.full(start, 1 / (start + 1)), burn_in=10, samples=40, theta=1.0, seed=2)
    for part in (range(100), range(100, 140)):
        got, want = (sum(f(i) for i in part) for f in (lambda i: rows[i]["score"], lambda i: sum(math.log10(p[u, w]) for u, w in pairs(i))))
        assert got == pytest.approx(want, rel=0.01)
    assert sum(rows[i]["score"] for i in range(100, 140)) > 0.9 * sum(rows[i]["base_score"] for i in range(100, 140))


def test_rare_words_are_seated_in_every_sweep_as_frequent_ones(spark):
    """Whether a word is broadcast or met in joins, its tables and probabilities are those of each sweep, so scores are the same."""
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(40))) for i in range(60)]
    docs = make(spark, texts)
    whole, mixed, rare = (by_id(pitman.score(docs, docs["doc_id"] < 50, head=x)) for x in (1e-9, 0.02, 1.0))
    for i, _ in texts:
        for some in (mixed, rare):
            assert some[i]["score"] == pytest.approx(whole[i]["score"], rel=1e-9)
            assert (some[i]["n_known"], some[i]["base_score"]) == (whole[i]["n_known"], pytest.approx(whole[i]["base_score"]))


def test_sorted_keys_come_back():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 5000):
        for low in (0, 1 << 63):
            keys = np.sort(rng.integers(0, 1 << 62, n, np.uint64)) + np.uint64(low)
            assert (pitman.unpack_sorted(pitman.pack_sorted(keys)) == keys).all()
    assert len(pitman.pack_sorted(keys)) < 8 * len(keys)


def test_many_customers_of_one_pair_get_the_tables_of_one_by_one():
    rng = np.random.default_rng(8)
    for c, base, others in ((20, 0.1, 30), (300, 0.01, 500), (900, 0.2, 50)):
        m = 2000
        t = np.ones(m)
        for n in range(1, c):
            a = (1 + 0.6 * (others + t)) * base
            t += rng.random(m) * (n - 0.6 * t + a) < a
        got = pitman.seat_by_key(np.full(m, c), np.full(m, base), np.full(m, others), 1.0, 0.6, pitman.keyed(np.arange(m, dtype=np.uint64), 1, 5))
        assert abs(got.mean() - t.mean()) < 5 * t.std() * math.sqrt(2 / m) + 0.01 * t.mean()


def test_base_scores_and_counts(spark, awkward, nothing):
    docs = awkward
    rows = pitman.score(docs, docs["doc_id"] != 8, head=0.2, dish=0.05, context=0.1).collect()
    assert len(rows) == len(AWKWARD) and pitman.score(nothing, nothing["doc_id"] > 0).count() == 0
    tokens = lambda t: [w for w in (t or "").encode().translate(LOWER).split()] + [b"\n"]
    c = collections.Counter(w for i, t in AWKWARD if i is not None and i != 8 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens(dict(AWKWARD)[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r["score"] < 0 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(t)))
    untaught = pitman.score(docs, docs["doc_id"] < 0).collect()
    assert {(r["score"], r["base_score"], r["n_known"]) for r in untaught} == {(0.0, 0.0, 0)}


# --- byte-level BPE ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_ids_are_those_of_the_reference_library(ranks):
    own = bpe.Codec(bpe.model_proto(ranks), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    signs = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "Ab", "é", "1", "٣", "漢", ".", "!?", "'s", "'", "'ll", "́", "😀", "\x00", "ſ", " x", "​"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t in AWKWARD] + ["a" * 3000, " " * 3000]
    for text, ids in zip(texts, own.packed(texts)):
        assert list(memoryview(ids).cast("I")) == ref.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_model_with_missing_ranks_and_own_vocabulary():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301}
    own = bpe.Codec(bpe.model_proto(ranks), r"\S+|\s+")
    assert list(memoryview(own.packed(["abcab x"])[0]).cast("I")) == [301, 300, 32, 120]


def test_digests_of_rows(spark, awkward, nothing, ranks):
    rows = bpe.digests(awkward, ranks, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(AWKWARD) and bpe.digests(nothing, ranks, public_tokenizers.PATTERN).count() == 0
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256((dict(AWKWARD)[r["doc_id"]] or "").encode()).hexdigest()
    plain = by_id(bpe.encode(awkward, ranks, public_tokenizers.PATTERN))
    assert plain[6]["decoded"] == LONG.encode() and plain[1]["ids"] == b""


# --- embeddings -------------------------------------------------------------------------------------------------------


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.12
    clique = base[0] + rng.normal(size=(80, 16)) * 0.1
    x = np.concatenate([base, near, clique]).astype(np.float32)
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)] + [(1000, [float(f) for f in x[5]]), (1000, [float(f) for f in x[5]])]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None]), (2004, [float("nan")] * 16), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0])]
    got, told = nndescent.near_duplicates(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>"))
    ids, v = [i for i, _ in rows], np.array([e for _, e in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    reach = np.linalg.matrix_power((link | np.eye(len(v), dtype=bool)).astype(float), 60) > 0
    want = sorted((ids[k], int(link[k].sum()), min(np.array(ids)[reach[k]])) for k in range(len(v)))
    found = sorted(tuple(r) for r in got.collect() if r["vec_id"] < 2000)
    assert told["recall"] >= 0.98
    assert found == want
    assert sorted(tuple(r) for r in got.collect() if r["vec_id"] >= 2000) == [(i, 0, i) for i, _ in odd]
    assert nndescent.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))[0].count() == 0


def test_isolated_pairs_beside_a_large_cluster_are_found(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=16)
    x = [middle + rng.normal(size=16) * 0.02 for _ in range(150)]
    for _ in range(60):
        one = rng.normal(size=16) * np.linalg.norm(middle) / 4
        x += [one, one + rng.normal(size=16) * np.linalg.norm(one) * 0.04]
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)]
    # the audit queries see the cluster above all, and one short table finds few pairs
    got, told = nndescent.near_duplicates(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), tables=1, most_tables=1, reach=1, rounds=0, audit=20)
    v = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    assert told["exact"] and link[150:].any(axis=1).mean() > 0.9
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    assert [found[i][0] for i in range(len(x))] == link.sum(axis=1).tolist()
    reach = np.linalg.matrix_power((link | np.eye(len(v), dtype=bool)).astype(float), 30) > 0
    assert [found[i][1] for i in range(len(x))] == reach.argmax(axis=1).tolist()


def test_sparse_pairs_are_found_without_comparing_blocks(spark):
    rng = np.random.default_rng(12)
    x = [*rng.normal(size=(2970, 32))]
    for k in range(30):
        noise = rng.normal(size=32)
        noise -= noise @ x[k] / (x[k] @ x[k]) * x[k]
        x.append(x[k] + noise / np.linalg.norm(noise) * np.linalg.norm(x[k]) * (0.05 + 0.009 * k))
    rows = [(i, [float(f) for f in v], "a", 1.0, b"k") for i, v in enumerate(x)]
    schema = "vec_id bigint, embedding array<double>, comp string, sim double, key binary"
    got, told = nndescent.near_duplicates(spark.createDataFrame(rows, schema))
    v = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    link = v @ v.T >= 0.95
    np.fill_diagonal(link, False)
    assert not told["exact"] and told["audited_apart"] >= 50 and told["recall_apart"] >= 0.98
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    want = {i: (int(link[i].sum()), min([i, *np.flatnonzero(link[i])])) for i in range(3000)}
    assert found == want and sum(n for n, _ in want.values()) >= 60


def test_parity_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(2)
    for n in (1, 5, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, n // 8).astype(np.uint64)]))
        differ = sum(int(x).bit_count() for x in (jaccard.parity_sketch(a) ^ jaccard.parity_sketch(b)).view(np.uint64))
        apart = len(np.setxor1d(a, b))
        assert differ <= apart and (differ - apart) % 2 == 0 and (n != 300 or differ > 0.9 * apart)


def test_few_links_leave_no_rounds_behind(spark):
    """Rounds over few links are gathered, and stages that nothing reads any more are deleted."""
    folder = _common.shared_folder(spark).split(":")[-1]
    before = set(os.listdir(folder))
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    found = components(links)
    assert found.where("comp = 0").count() == 41
    left = set(os.listdir(folder)) - before
    assert len(left) == 1
    files = [f for f in os.listdir(f"{folder}/{left.pop()}") if f.endswith(".parquet")]
    assert len(files) <= 2  # not one for each shuffle partition


def test_tokens_of_a_chunk_are_packed_by_frequency():
    rng = np.random.default_rng(1)
    tokens = rng.permutation(3_000)[rng.zipf(1.3, 50_000) % 3_000]
    order, packed = pitman.pack_tokens(tokens, 3_000)
    assert (pitman.unpack_tokens(order, packed) == tokens).all()
    assert len(order) + len(packed) < len(pitman.pack(tokens.astype(np.uint32)))
    empty = np.zeros(0, np.int64)
    assert not len(pitman.unpack_tokens(*pitman.pack_tokens(empty, 1)))
