"""Exact Jaccard join of word-shingle sets by token-combination prefixes.

Tokens (shingle hashes) are ordered rare first. A set of n tokens may miss at most d = n - ceil(t n) of them in a
partner, so a prefix that survives any d misses must share something with the partner's prefix. Tokens that are
rare in the corpus are indexed alone. Tokens of the two frequent classes are indexed by combinations of k = 2 and
k = 3 of them: a class's tokens are dealt by hash into groups, j tokens of a group survive with a common
combination after max(0, j - k + 1) more misses, and the prefix is extended until all groups together survive
d + 1, and some more: then partners share several entries, and a set that shares fewer with all others is done. The number of groups goes with the size of the sets (a set near the border of two size tiers is indexed in
both), so the combinations of a set stay in proportion to its size. Sets so small that even one more token would
part them (n < t (n + 1)) link only if they are equal and have no entries; a set that may miss nothing but fits into
a larger one, as 9 tokens into 10 at 0.9, has.

Equal sets are one class from the start. Classes that share an index entry are compared as a star around one of
them, which is drawn anew each round, as long as rounds find links; classes that are already connected are not compared
again. What stars leave
apart is compared pair by pair within the join over entries, by size and by a sketch: a bit per token, taken to the
parity of how many tokens fall on it. Two sketches differ in at most as many bits as the sets differ in tokens, so a
pair whose sketches differ in more bits than a link allows is no link, and only what passes leaves the join, listed at
the first entry that both sets have among their smallest ones instead of once per entry. No link between different
components is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.llm._common import distinct, drop_stored, free_shuffles, gram_hashes, map_arrow, mixed, sent, store, text_bytes, text_key, word_hashes
from priorform.llm.components import components

CELLS = 24  # bits of the frequency sketch: 16 MB of levels, whatever the corpus
BLOCK = 1 << 18
TEXTS = 1024  # taken at once
HEAD = 8  # smallest entries of a set by which a pair finds the first one that it shares
LIGHT = 8  # entries of a set that take part in star rounds
RARE, COMMON = 64, 4096  # estimated documents of a token up to which it is indexed alone, or in pairs
TIER = 4
SKETCH = 32  # words of 64 bits of a set's parity sketch


def shingles(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """For each text the set of word shingles as sorted 64-bit hashes; a shorter text is one shingle, an empty one none."""
    for words in word_hashes(texts):
        yield distinct(gram_hashes(words, min(width, len(words)))) if len(words) else words


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """``64 * SKETCH`` bits: the parity of the number of tokens that fall on each."""
    odd = np.bincount(((mixed(tokens) >> np.uint64(20)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts of a block, a byte each where that suffices; the others follow the bytes as pairs of place and count."""
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(small.tobytes() + large.astype(np.int64).tobytes() + counts[large].astype(np.int64).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    counts = np.frombuffer(raw, np.uint8, BLOCK).astype(np.int64)
    place, large = np.frombuffer(raw, np.int64, offset=BLOCK).reshape(2, -1)
    counts[place] = large
    return counts


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELLS)).astype(np.int64)


def levels_of(counts: np.ndarray, mean: float) -> np.ndarray:
    """Rounded logarithm of how many documents hold a token of the cell, above what chance puts there."""
    excess = np.clip(counts - (mean + 4 * np.sqrt(mean)), 0, None)
    return np.floor(np.log2(1 + excess)).astype(np.uint8)


def shared_least(n: int, percent: int) -> int:
    """How many index entries a set of n tokens has at least in common with any partner."""
    return 1 + 3 * -(-percent * n // 100) // 100


def tiers_of(n: int, percent: int) -> list[int]:
    """First sizes of the tiers in which a set of n tokens is indexed; similar sets share a tier."""
    out, low = [], 1
    while low * percent <= n * 100:
        if low <= n < low * TIER or n < low <= n * 100 // percent:
            out.append(low)
        low *= TIER
    return out


def _combinations(tokens: np.ndarray, groups: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of all k-combinations inside each group."""
    out = []
    order = np.argsort(groups, kind="stable")
    tokens, groups = tokens[order], groups[order]
    for part in np.split(tokens, np.flatnonzero(np.diff(groups)) + 1):
        part = mixed(np.sort(part) + np.uint64(salt))
        if len(part) < k:
            continue
        i, j = np.triu_indices(len(part), 1)
        two = part[i] * np.uint64(3) + part[j] * np.uint64(5)
        if k == 2:
            out.append(mixed(two))
            continue
        for m in range(2, len(part)):  # every pair below m, with m
            out.append(mixed(two[j < m] * np.uint64(7) + part[m]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def index_entries(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of a set, given as sorted tokens. Equal sets apart, two sets of Jaccard similarity ``percent`` share at least
    ``shared_least`` of either set: prefixes are longer by what the smallest partner asks."""
    n = len(tokens)
    misses = n - -(-percent * n // 100)
    least = 1 + 3 * n // 100
    if 100 * n < percent * (n + 1):  # the smallest larger partner is too large already
        return np.zeros(0, np.uint64)
    level = levels[cell_of(tokens)]
    order = np.argsort(level, kind="stable")  # tokens of a level stay sorted
    tokens, level = tokens[order], level[order]
    alone = int((level <= np.log2(1 + RARE)).sum())
    if alone >= misses + least:
        return mixed(tokens[: misses + least])
    out = [mixed(tokens[:alone])]
    pairs = int((level <= np.log2(1 + COMMON)).sum())
    for low in tiers_of(n, percent):
        need = misses + least - alone
        for k, part, groups in ((2, tokens[alone:pairs], max(1, low // 8)), (3, tokens[pairs:], max(1, low // 16))):
            if need <= 0 or not len(part):
                continue
            group = (part >> np.uint64(8)).astype(np.int64) % groups
            rank = np.zeros(len(part), np.int64)
            by = np.argsort(group, kind="stable")
            first = np.concatenate([[True], np.diff(group[by]) != 0])
            rank[by] = np.arange(len(part)) - np.maximum.accumulate(np.where(first, np.arange(len(part)), 0))
            gained = np.cumsum(rank >= k - 1)
            stop = int(np.searchsorted(gained, need)) + 1
            need -= int(gained[min(stop, len(part)) - 1])
            out.append(_combinations(part[:stop], group[:stop], k, low * 4 + k))
    return distinct(np.concatenate(out))


def _facts_and_counts(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows of documents (id, class key, size) and, at the end of a partition, blocks of its token counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, k bigint, o binary, short bigint, n bigint, block int, counts binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << CELLS, np.uint32), False

        def rows(*columns):
            size = max(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.array(v if v is not None else [None] * size, f.type) for v, f in zip(columns, target)], schema=target)

        for batch in batches:
            o, n = [], []
            for s in shingles(batch.column(2).to_pylist(), width):
                n.append(len(s))
                o.append(_key(s) if len(s) else None)
                np.add.at(counts, cell_of(s), np.uint32(1))
            seen = seen or bool(n)
            if n:
                yield rows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), o, [_short(x) if x else None for x in o], n, None, None)
        if seen:
            blocks = list(range(len(counts) // BLOCK))
            yield rows(None, None, None, None, None, blocks, [packed(counts[b * BLOCK : (b + 1) * BLOCK]) for b in blocks])

    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("k"), text_bytes(text_col).alias("text")).mapInArrow(run, schema)


def _levels(blocks: DataFrame, mean: float) -> np.ndarray:
    """Sum the partitions' counts block by block and turn them into levels, one byte a cell."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[block] = total.get(block, 0) + unpacked(data.as_py())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([levels_of(v, mean).tobytes() for v in total.values()], pa.binary())], names=["block", "levels"])

    levels = np.zeros(1 << CELLS, np.uint8)
    for block, data in blocks.repartition(64, "block").mapInArrow(add, "block int, levels binary").toLocalIterator():
        levels[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, np.uint8)
    return levels


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    """The first half of a class key. Two classes that share it are told apart when they are verified."""
    return int.from_bytes(key[:8], "little", signed=True)


def _shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (entry, owner, least) rows those whose entry has another owner; holds one row between batches."""
    held, kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], False
    names = ["e", "o", "least"]
    for batch in batches:
        rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
        e, o = rows[:2]
        new = np.concatenate([[True], (e[1:] != e[:-1]) | (o[1:] != o[:-1])])[: len(e)]
        rows = [r[new] for r in rows]
        if not len(rows[0]):
            continue
        same = rows[0][1:] == rows[0][:-1]
        before, after = np.concatenate([[kept], same]), np.concatenate([same, [False]])
        keep = (before | after)[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(r[:-1][keep]) for r in rows], names=names)
        held, kept = [r[-1:] for r in rows], bool(before[-1])
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in held], names=names)


def _pruned(live: DataFrame) -> DataFrame:
    """Without owners that share fewer entries than any partner would ask, and entries left with one owner."""
    enough = live.groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("m")).where("n >= m").select("o")
    left = live.join(enough, "o", "left_semi")
    shared = left.groupBy("e").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("e")
    out = store(left.join(shared, "e", "left_semi"))
    drop_stored(live)
    return out


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` (class keys) among candidate pairs ``x, y`` of short keys."""

    def check(cols):
        out = {"a": [], "b": []}
        for a, b, s, t in zip(cols["a"], cols["b"], cols["s"], cols["t"]):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            common = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * common >= percent * (len(s) + len(t) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    left = sets.select(F.col("short").alias("x"), F.col("o").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("s"))
    right = sets.select(F.col("short").alias("y"), F.col("o").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t"))
    sizes = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    near = sent(sent(pairs, n_pairs).join(left.drop("s"), "x"), n_pairs).join(right.drop("t"), "y").where(sizes & (F.col("a") != F.col("b"))).select("x", "y")
    both = sent(near, n_pairs).join(left, "x").join(right, "y").select("a", "b", "s", "t")
    return map_arrow(both, check, "a binary, b binary")


def link(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 4) -> DataFrame:
    """``id, n_shingles, component_id, group_key, text_key`` per input row (no group without shingles).

    Words are cut at ASCII white space after lower-casing A to Z. Documents link when 100 times the
    intersection is at least ``percent`` (80 or more) times the union of their shingle sets; ``component_id``
    is the smallest id reachable by links, itself included (null only if all of them are null). Null and empty
    texts have no shingles and no links. Repeated rows are repeated in the result. Other columns are not read.
    """
    if percent < 80:
        raise ValueError("prefixes of token combinations are complete for 80 percent and more")
    spark = docs.sparkSession
    texts = docs.select(text_key(text_col).alias("k"), text_bytes(text_col).alias("text"))
    both = store(_facts_and_counts(docs, id_col, text_col, width))
    facts = both.where("block is null").select("id", "k", "o", "short", "n")
    mean = (facts.agg(F.sum("n")).first()[0] or 0) / (1 << CELLS)
    levels = spark.sparkContext.broadcast(_levels(both.where("block is not null").select("block", "counts"), mean))

    def entries(cols):
        out, owners, least = [], [], []
        for s in shingles([*{*cols["text"]}], width):
            e = index_entries(s, levels.value, percent) if len(s) else s
            if len(e):
                out.append(e)
                owners.append(np.full(len(e), _short(_key(s)), np.int64))
                least.append(np.full(len(e), shared_least(len(s), percent), np.int32))
        if not out:
            return None
        return {"e": pa.array(np.concatenate(out).view(np.int64)), "o": pa.array(np.concatenate(owners)), "least": pa.array(np.concatenate(least))}

    columns = "e bigint, o bigint, least int"
    index = map_arrow(texts.select("text"), entries, columns, rows=TEXTS)
    live = store(index.repartition("e").sortWithinPartitions("e", "o").mapInArrow(_shared_entries, columns))
    for _ in range(2):
        live = _pruned(live)
    owners = live.select(F.col("o").alias("short")).distinct()
    # one text of every class that meets others; a bitmap of 2 MB, by the first 24 bits of the texts' keys, spares the rest
    chosen = store(facts.join(owners, "short", "left_semi").groupBy("o").agg(F.min("k").alias("k")).select("k").distinct())
    cells = chosen.select(F.expr("shiftrightunsigned(k, 45)").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(k, 40) & 31 as int))").alias("b"))
    bitmap = np.zeros(1 << 19, np.uint32)
    for w, b in cells.groupBy("w").agg(F.bit_or("b")).collect():
        bitmap[w] = b
    shipped = spark.sparkContext.broadcast(bitmap)

    def sets_of(cols):
        out = {"short": [], "o": [], "n": [], "tokens": [], "sketch": []}
        place = (np.array(cols["k"], np.int64).view(np.uint64) >> np.uint64(40)).astype(np.int64)
        asked = shipped.value[place >> 5] >> (place & 31).astype(np.uint32) & 1
        for s in shingles([*{t for t, a in zip(cols["text"], asked) if a}], width):
            if len(s):
                key = _key(s)
                for name, v in zip(out, (_short(key), key, len(s), s.tobytes(), parity_sketch(s))):
                    out[name].append(v)
        return out

    wanted = map_arrow(texts, sets_of, "short bigint, o binary, n bigint, tokens binary, sketch array<bigint>", rows=TEXTS)
    sets = store(wanted.join(owners, "short", "left_semi").dropDuplicates(["o"]))

    # one row per owner: its entries are listed out only where they are looked at
    lists = store(live.groupBy("o").agg(F.collect_list("e").alias("es"), F.max("least").alias("least")))
    tested, edges, labels = None, None, None
    n_tested, n_labels = 0, 0
    drop_stored(live, chosen)
    turn, stars = 0, True
    while True:
        free_shuffles(spark)
        stars = stars and turn < star_rounds
        owners = lists
        if labels is None:
            owners = owners.withColumn("c", F.col("o"))
        else:
            comp = sets.join(sent(labels, n_labels), sets["o"] == labels["node"])
            comp = sent(comp.groupBy("short").agg(F.min(F.xxhash64("comp")).alias("d")), n_labels)
            owners = owners.join(comp, owners["o"] == comp["short"], "left").select("o", "es", "least", F.coalesce("d", "o").alias("c"))
        if stars:  # a star around one owner of each entry, over few entries of each owner
            few = F.slice(F.sort_array(F.transform("es", lambda e: F.struct(F.xxhash64(e).alias("h"), e.alias("e")))), 1, LIGHT)
            now = owners.select("o", "c", F.explode(few).alias("x")).select("o", "c", F.col("x.e").alias("e"))
            drawn = F.xxhash64("o", F.lit(turn))
            centre = now.groupBy("e").agg(F.min_by("o", drawn).alias("p"), F.min_by("c", drawn).alias("d"), F.min("c").alias("lo"), F.max("c").alias("hi"))
            near = now.join(centre.where("lo <> hi"), "e").where("o <> p and c <> d")
            pairs = near.groupBy(F.least("o", "p").alias("x"), F.greatest("o", "p").alias("y")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
        else:  # what stars left apart: every pair that is not connected yet and may link by sizes and sketches
            # partners share ``least`` entries or more, so the smallest one they share is not among the last ``least - 1`` of either (with fewer entries than that there is no partner)
            first = F.slice(F.sort_array("es"), F.lit(1), F.greatest(F.size("es") - F.col("least") + 1, F.lit(0)))
            now = owners.select("o", "c", F.slice(F.sort_array("es"), 1, HEAD).alias("head"), F.explode(first).alias("e"))
            split = now.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("e")
            bits = sets.select(F.col("short").alias("o"), "n", *[F.get("sketch", i).alias(f"s{i}") for i in range(SKETCH)])
            now = store(now.join(split, "e").join(bits, "o"))
            other = now.select(F.col("e").alias("f"), F.col("o").alias("p"), F.col("c").alias("d"), F.col("head").alias("heads"), F.col("n").alias("q"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH)])
            apart = reduce(lambda u, v: u + v, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(SKETCH)])
            able = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("q"))
            sizes = (100 * F.col("n") >= percent * F.col("q")) & (100 * F.col("q") >= percent * F.col("n"))
            # a pair is listed where no smaller entry is seen in both heads: once, as a rule
            listed = F.coalesce(F.array_min(F.array_intersect("head", "heads")) >= F.col("e"), F.lit(True))
            met = now.join(other, (F.col("e") == F.col("f")) & (F.col("o") < F.col("p")) & (F.col("c") != F.col("d")) & sizes & able & listed)
            pairs = met.select(F.col("o").alias("x"), F.col("p").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(sent(tested, n_tested), ["x", "y"], "left_anti")
        pairs = store(pairs)
        if not stars:
            drop_stored(now)
        n_pairs = pairs.count()
        some = n_pairs > 0
        if some:
            tested, n_tested = pairs if tested is None else tested.unionByName(pairs), n_tested + n_pairs
            found = store(_verified(pairs, n_pairs, sets, percent))
            some = not found.isEmpty()
        if some:
            edges = found if edges is None else edges.unionByName(found)
            if labels is not None:
                drop_stored(labels)
            labels = components(edges)
            n_labels = labels.count()
        if not stars:
            break
        turn, stars = turn + 1, some
    drop_stored(*(x for x in (lists, sets, tested, edges) if x is not None))

    classes = facts.where("o is not null").groupBy("o").agg(F.min("id").alias("least"))
    if labels is not None:
        named = classes.join(labels, classes["o"] == labels["node"], "left").select("o", "least", F.coalesce("comp", "o").alias("comp"))
        least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        classes = named.join(least, "comp").select("o", "component_id", "comp")
    else:
        classes = classes.select("o", F.col("least").alias("component_id"), F.col("o").alias("comp"))
    out = facts.join(classes, "o", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("comp").alias("group_key"), F.col("k").alias("text_key"))
