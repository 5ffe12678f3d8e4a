"""Benchmark decontamination by winnowed fingerprints.

A fingerprint is the smallest k-gram hash of a window of consecutive k-grams. With ``k`` words a gram and
``window - k + 1`` grams a window, every span of ``window`` words that two texts share has a fingerprint both
keep at the same place of it. Both sides are fingerprinted; a bitmap of fixed size, made of the benchmark's
fingerprints and independent of how many there are, lets only promising document fingerprints through to the
shuffle; these join the benchmark's, and every hit is extended word by word to both sides. An item of fewer
than ``window`` words is one fingerprint of its own length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.llm._common import WORD_BYTES, WordHashes, gram_hashes, map_arrow, store, text_bytes, text_key

BITS = 24  # of the bitmap: 2 MB, whatever the size of the benchmark
POINT = "array<struct<h:bigint,p:int,words:array<bigint>>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def fingerprints(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the smallest of some window."""
    grams = gram_hashes(words, k)
    spread = window - k + 1
    n = len(grams) - spread + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, spread):
        np.minimum(least, grams[j : j + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for j in range(spread):
        chosen[j : j + n] |= grams[j : j + n] == least
    at = np.flatnonzero(chosen)
    return at, grams[at]


def around(words: np.ndarray, at: np.ndarray, window: int, k: int) -> np.ndarray:
    """The gram and ``window - k`` words on either side, 0 beyond the text's ends."""
    side = window - k
    padded = np.concatenate([np.zeros(side, np.uint64), words, np.zeros(side, np.uint64)])
    return padded[at[:, None] + np.arange(2 * side + k)[None, :]]


def item_points(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Fingerprints of a benchmark item: places, hashes, words around, and the length of its windows."""
    n = len(words)
    if n == 0 or n >= window:
        at, h = fingerprints(words, window, k)
        return at, h, around(words, at, window, k), window
    at = np.zeros(1, np.int64)
    return at, gram_hashes(words, n), around(words, at, n, n), n


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = 10, k: int = 6) -> tuple[DataFrame, DataFrame]:
    """Documents ``id, k, n_words`` (one row per input row) and spans ``id, k, start, end, items``.

    ``k`` is a key of the text; a span is a run of words that also stands in each of ``items``, every word of
    it inside an occurrence of a window. Null and empty texts have no words and no spans, and such items no
    windows. Rows that share id and text get the same spans.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    hashes = WordHashes()

    def of_items(cols):
        out = {"size": [], "h": [], "words": [], "item": []}
        for item, text in zip(cols["item"], cols["text"]):
            at, h, ctx, size = item_points(hashes.of(words_of(text)), window, k)
            out["size"] += [size] * len(at)
            out["h"] += h.view(np.int64).tolist()
            out["words"] += ctx.view(np.int64).tolist()
            out["item"] += [item] * len(at)
        return out

    bench = items.select(F.col(item_col).cast("string").alias("item"), text_bytes(text_col).alias("text"))
    points = map_arrow(bench, of_items, "size int, h bigint, words array<bigint>, item string")
    points = store(points.groupBy("size", "h", "words").agg(F.sort_array(F.collect_set("item")).alias("items")))
    shorter = sorted(r[0] for r in points.select("size").distinct().collect() if r[0] < window)
    place = F.shiftrightunsigned(F.col("h"), 64 - BITS)
    cells = (
        points.select(F.shiftright(place, 5).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 31 as int))").alias("bit"))
        .groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()
    )
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    for cell, bits in cells:
        bitmap[cell] = bits
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)

    def promising(at, h):
        where = (h >> np.uint64(64 - BITS)).astype(np.int64)
        ok = (shipped.value[where >> 5] >> (where & 31).astype(np.uint32)) & 1 == 1
        return at[ok], h[ok]

    def of_docs(cols):
        sizes, points_ = [], []
        for text in cols["text"]:
            words = hashes.of(words_of(text))
            sizes.append(len(words))
            found = []
            at, h = promising(*fingerprints(words, window, k))
            if len(at):
                ctx = around(words, at, window, k).view(np.int64).tolist()
                found += [{"h": a, "p": b, "words": c} for a, b, c in zip(h.view(np.int64).tolist(), at.tolist(), ctx)]
            for n in shorter:
                h = gram_hashes(words, n)
                at, h = promising(np.arange(len(h)), h)
                found += [{"h": a, "p": b, "words": c} for a, b, c in zip(h.view(np.int64).tolist(), at.tolist(), around(words, at, n, n).view(np.int64).tolist())]
            points_.append(found)
        return {"id": cols["id"], "k": cols["k"], "n_words": sizes, "points": points_}

    read = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("k"), text_bytes(text_col).alias("text"))
    facts = store(map_arrow(read, of_docs, f"id {id_type}, k bigint, n_words bigint, points {POINT}"))
    wanted = facts.where(F.size("points") > 0).select("id", "k", F.explode("points").alias("x")).select("id", "k", "x.h", "x.p", "x.words")

    def extend(cols):
        out = {"id": [], "k": [], "start": [], "end": [], "items": []}
        for i, key, p, mine, theirs, n, names in zip(*(cols[c] for c in ("id", "k", "p", "words", "other", "size", "items"))):
            g = n if n < window else k
            side = n - g
            if mine[side : side + g] != theirs[side : side + g]:
                continue
            left = right = 0
            while left < side and mine[side - 1 - left] == theirs[side - 1 - left] != 0:
                left += 1
            while right < side and mine[side + g + right] == theirs[side + g + right] != 0:
                right += 1
            if left + g + right >= n:
                for name, v in zip(out, (i, key, p - left, p + g + right, names)):
                    out[name].append(v)
        return out

    met = wanted.withColumn("n", F.size("words")).join(
        points.select("h", F.col("words").alias("other"), "size", "items", F.size("words").alias("n")), ["h", "n"]
    ).select("id", "k", "p", "words", "other", "size", "items")
    spans = map_arrow(met, extend, f"id {id_type}, k bigint, start int, end int, items array<string>").distinct()
    return facts.select("id", "k", "n_words"), store(spans)


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, n_items, items (sorted), contaminated, text_key``; see :func:`hits`."""
    id_col = options.get("id_col", "doc_id")
    facts, spans = hits(docs, items, **options)

    def cover(cols):
        n_hit = []
        for starts, ends in zip(cols["starts"], cols["ends"]):
            order = np.argsort(starts, kind="stable")
            s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
            n_hit.append(int((e - np.maximum(s, np.concatenate([[0], e[:-1]]))).clip(0).sum()))
        return {"id": cols["id"], "k": cols["k"], "n_hit": n_hit, "items": cols["items"]}

    both = spans.groupBy("id", "k").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    covered = map_arrow(both, cover, f"id {id_type}, k bigint, n_hit bigint, items array<string>")
    joined = facts.alias("f").join(covered.alias("c"), F.col("f.id").eqNullSafe(F.col("c.id")) & (F.col("f.k") == F.col("c.k")), "left")
    return joined.select(
        F.col("f.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
        F.col("f.k").alias("text_key"),
    )
