"""Repeated bytes, clusters and ranked search against plain code, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from priorform.llm import ptolemy, strata, suffixes

DOCS = "doc_id bigint, text string, place string, end string, x string, m string, tf string, score string"
LONG = "lorem ipsum dolor " * 3000 + "sit" * 4000


def make(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in texts], DOCS)


AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, LONG), (7, "same text here again " * 9), (7, "same text here again " * 9),
           (8, "same text here again " * 9), (None, "no id at all, but long enough to be found again: " + "abc " * 20), (9, "no id at all, but long enough to be found again: " + "abc " * 20),
           (10, "Ünïcode ßtraße 漢字 😀  " * 12), (11, "x Ünïcode ßtraße 漢字 😀  " * 12), (12, "ß" * 49), (13, "ß" * 50), (14, "ß" * 50 + "x")]


# --- repeated bytes ---------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    place = lambda i, p: (i is not None, i or 0, p)
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, place(i, p)), place(i, p))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < place(i, p):
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeats(docs, length=100):
    rows = suffixes.remove_repeats(docs, length=length).collect()
    for r in rows:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert spans == sorted(spans) and len(spans) == r["n_spans"] and sum(e - s for s, e in spans) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"] or b"").hexdigest()) for r in rows), key=str)


def test_repeats_of_awkward_rows(spark):
    assert repeats(make(spark, AWKWARD)) == brute_repeats(AWKWARD, 100)
    assert repeats(make(spark, [])) == []
    assert repeats(make(spark, [(1, None), (2, "short")])) == brute_repeats([(1, None), (2, "short")], 100)


@pytest.mark.parametrize("bucket", [8192, 5])
@pytest.mark.parametrize("length,signs,seed", [(100, "ab", 1), (100, "abcdefgh ", 2), (40, "ab", 3), (64, "aaaaaaab", 4), (159, "abcd", 5)])
def test_repeats_of_copies_with_changes(spark, monkeypatch, length, signs, seed, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)  # larger buckets are refined over the cluster first
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(signs) for _ in range(n))
    families = [word(rng.choice([150, 400, 900])) for _ in range(4)] + [word(7) * 40, "z" * 300]
    texts = []
    for i in range(90):
        parts = [rng.choice(families) for _ in range(rng.choice([1, 1, 2]))]
        text = list("".join(p[rng.randrange(60) : len(p) - rng.randrange(60)] for p in parts))
        for _ in range(rng.choice([0, 1, 2, 5, 12])):
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[at] = rng.choice(signs + "XY")
            else:
                del text[at]
        texts.append((rng.randrange(60), "".join(text)))
    assert repeats(make(spark, texts), length) == brute_repeats(texts, length)


def test_halving_settles_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PLAIN_ROUNDS", 0)
    monkeypatch.setattr(suffixes, "BUCKET", 3)
    rng = random.Random(9)
    base = "".join(rng.choice("abcd") for _ in range(500))
    texts = [(i, base[: (at := rng.randrange(500))] + "X" * rng.randrange(3) + base[at:]) for i in range(40)]
    assert repeats(make(spark, texts)) == brute_repeats(texts, 100)


def test_pieces_of_a_long_text_join(spark, monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choice(b"abc") for _ in range(3000))
    whole = [x.tolist() for x in suffixes.samples(data, 100)]
    monkeypatch.setattr(suffixes, "PIECE", 256)
    assert [x.tolist() for x in suffixes.samples(data, 100)] == whole
    covered = np.zeros(3000 - 99, int)
    for a in whole[0]:
        covered[max(0, a - 68) : a + 1] += 1
    assert covered.all()


# --- clusters ---------------------------------------------------------------------------------------------------------


def brute_clusters(rows, width, k, rounds, seed):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    for turn in range(rounds + 1):
        best = [min((far(q, c), n) for n, c in enumerate(centroids)) for _, q in kept]
        if turn < rounds:
            for n in range(len(centroids)):
                own = [q for (_, q), (_, c) in zip(kept, best) if c == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    inertia = Counter()
    for d, c in best if kept else []:
        inertia[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), name(c)) for (i, _), (d, c) in zip(kept, best if kept else [])), key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, q string, far string, cluster string"


def clusters(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "a", "b", "c", "d") for i, v in rows], VECTORS)
    found = ptolemy.cluster(df, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured"]
    return sorted((tuple(r)[:6] for r in found.collect()), key=str)


def test_clusters_are_those_of_all_distances(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.2, size=8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(5, rows[5][1])] * 3  # repeated vectors and rows
    rows += [(2000, None), (2001, [1.0] * 7), (2002, [1.0] * 9), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8), (2005, [float("inf")] * 8), (None, [0.0] * 8), (2006, []), (2007, [-3.0] * 8)]
    options = dict(width=8, k=12, rounds=5, seed=2)
    assert clusters(spark, rows, **options) == brute_clusters(rows, **options)


def test_clusters_with_ties_and_few_vectors(spark):
    options = dict(width=2, k=5, rounds=3, seed=2)
    grid = [(i, [float(i % 4), float(i // 4)]) for i in range(16)]  # many equal distances
    assert clusters(spark, grid, **options) == brute_clusters(grid, **options)
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    assert clusters(spark, few, **options) == brute_clusters(few, **options)
    assert clusters(spark, [], **options) == [] and clusters(spark, [(1, None)], **options) == []
    with pytest.raises(Exception, match="reaches"):
        clusters(spark, [(1, [1e9, 0.0])], **options)


def test_ptolemaic_bounds_never_exceed_distances_and_save_some():
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (12, 16))
    rows = centres[rng.integers(0, 12, 3000)] + rng.integers(-20, 20, (3000, 16))
    pivots = rows[:5]
    to, of, between = ptolemy.roots(rows, pivots), ptolemy.roots(centres, pivots), ptolemy.roots(pivots, pivots)
    exact = ((rows[:, None, :] - centres[None, :, :]) ** 2).sum(2)
    assert (ptolemy.bounds(to, of, between) <= exact).all()
    number, distance, measured = ptolemy.nearest(rows, to, centres, of, between)
    assert (distance == exact.min(1)).all() and (number == exact.argmin(1)).all()
    assert measured < 0.5 * exact.size


# --- ranked search ----------------------------------------------------------------------------------------------------


def brute_search(docs, items, k, share=25):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().translate(suffix_lower))
    counted = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        asked = Counter(words(text))
        scores = []
        for i, c, n in counted:
            m = 100 - share + share * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, rank, i if has else None, -s) for rank, (s, has, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


suffix_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def searched(spark, docs, items, k, item_type="string"):
    bench = spark.createDataFrame(items, f"item_id {item_type}, text string")
    found = strata.search(strata.build(make(spark, docs)), bench, k=k)
    return sorted((tuple(r) for r in found.collect()), key=str)


def zipf_texts(rng, n, most):
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, most))) for _ in range(n)]


@pytest.mark.parametrize("block,postings", [(2048, 1 << 19), (7, 1 << 19), (2048, 60)])
def test_search_equals_all_scores(spark, monkeypatch, block, postings):
    monkeypatch.setattr(strata, "BLOCK", block)
    monkeypatch.setattr(strata, "POSTINGS", postings)
    rng = random.Random(block)
    docs = list(enumerate(zipf_texts(rng, 250, 120))) + AWKWARD + [(500 + i, "tie tie words") for i in range(30)]
    items = list(zip("abcdefgh", zipf_texts(rng, 8, 60))) + [("i", "Tie"), ("i", "tie WORDS"), ("j", None), ("k", "!!"), ("l", "unheard"), ("a", "same text"), ("m", "ßtraße 漢字 no id"), ("m", "ßtraße 漢字 no id")]
    assert searched(spark, docs, items, 20) == brute_search(docs, items, 20)
    assert searched(spark, docs, items, 3) == brute_search(docs, items, 3)


def test_search_in_turns_and_over_nothing(spark, monkeypatch):
    rng = random.Random(8)
    docs, items = list(enumerate(zipf_texts(rng, 60, 40))), [(n, t) for n, t in enumerate(zipf_texts(rng, 9, 20))]
    monkeypatch.setattr(strata, "ITEMS", 4)
    monkeypatch.setattr(strata, "TERMS", 25)
    assert searched(spark, docs, items, 5, "bigint") == brute_search(docs, items, 5)
    monkeypatch.setattr(strata, "EXACT", 1)  # whole numbers instead of doubles
    assert searched(spark, docs, items, 5, "bigint") == brute_search(docs, items, 5)
    assert searched(spark, [], items, 5, "bigint") == [] and searched(spark, [(1, None)], items, 5, "bigint") == []
    assert searched(spark, docs, [], 5, "bigint") == []

