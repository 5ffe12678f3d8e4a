"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A suffix is sampled where its ``GRAM``-byte hash is the smallest of some window of ``length`` bytes, so every string of
``length`` bytes holds a sampled place, and equal strings hold one at the same offset. The initial buckets are these
grams. A first sort by (gram, hash of the whole surroundings, place) settles what agrees with an earlier place in all
strings around it, and drops buckets of one. A bucket of at most ``BUCKET`` suffixes is then sorted to the end within a
task, by the hash of each of its strings. A larger one is refined first, over the cluster: every suffix is compared with
the bucket's first one, byte by byte to both sides; strings that agree are settled, and those that do not go to new
buckets that are longer by the bytes up to the difference, on the left or on the right. A bucket's bounds follow from the
bucket before and the place of the difference alone, so that equal strings always meet in one bucket.

"Earlier" means a smaller id, or the same id and a smaller start; null ids come first. Rows that share an id and a text
get the same result; with different texts under one id, places compare by start alone. Null and empty texts, and texts
shorter than ``length`` bytes, lose nothing. An empty table gives none. Texts are read in pieces, so that memory is
bounded by the text itself and not by its hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.llm._common import map_arrow, mixed, store, text_bytes

GRAM = 32  # bytes of an initial bucket; a power of two
PIECE = 1 << 20  # bytes of a text hashed at once
BUCKET = 8192  # suffixes of a bucket that a task sorts
TEXTS = 256  # taken at once
CRC = 0xFFFFFFFF  # the low half of a place
PLAIN_ROUNDS = 6  # after these, buckets' bounds are halved too, so that at most eight rounds follow
MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every place, by doubling."""
    h, k, factor = data.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    while k < GRAM:
        h = h[:-k] * np.uint64(factor) + h[k:]
        factor, k = factor * factor % (1 << 64), 2 * k
    return mixed(h)


def sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` consecutive values."""
    k = 1
    while 2 * k <= width:
        values, k = best(values[:-k], values[k:]), 2 * k
    return best(values[: -(width - k)], values[width - k :]) if k < width else values


def samples(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled places of a text and their gram hashes."""
    width = length - GRAM + 1
    places, hashes = [], []
    n = len(data)
    for start in range(0, max(n - length + 1, 0), PIECE):  # windows that begin in this piece
        g = gram_hashes(np.frombuffer(data, np.uint8, min(PIECE - 1 + length, n - start), start))
        least = sliding(np.minimum, g, width)
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), width) == g)
        places.append(at + start)
        hashes.append(g[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def surroundings(data: bytes, at: int, side: int) -> bytes:
    """The gram at a place with ``side`` bytes around it; zero bytes beyond the text's ends."""
    left = max(0, at - side)
    return data[left : at + GRAM + side].rjust(min(len(data), at + GRAM + side) - at + side, b"\0").ljust(2 * side + GRAM, b"\0")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans with the same bytes; spans that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], s[1:] > e[:-1]])
    return s[opens], e[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(e) - 1]])]


def _places(docs: DataFrame, id_type: str, length: int) -> DataFrame:
    """``gram, around, id, place, end``: sampled places; with ``end``, bytes repeated within one text instead.

    ``place`` is the start times 2^32 plus the text's CRC. A place whose surroundings stand earlier in its own text is
    settled here; such places become spans, so that a text of one repeated word does not give a row per byte.
    """
    side = length - GRAM

    def of(cols):
        out = {"gram": [], "around": [], "place": [], "end": []}
        owner = []
        for i, (data, crc) in enumerate(zip(cols["text"], cols["crc"])):
            if data is None or len(data) < length:
                continue
            at, g = samples(data, length)
            n, digest = len(data), xxhash.xxh3_64_intdigest
            around = np.fromiter((digest(data[max(0, a - side) : a + GRAM + side], min(a, side) * 256 + min(n - a - GRAM, side)) for a in at.tolist()), np.uint64, len(at))
            new = np.zeros(len(at), bool)
            new[np.unique(around ^ g, return_index=True)[1]] = True
            starts, ends = merged(np.maximum(at[~new] - side, 0), np.minimum(at[~new] + length, n))
            out["gram"] += [g[new].view(np.int64), mixed(starts.astype(np.uint64) + np.uint64(crc << 20)).view(np.int64)]
            out["around"] += [around[new].view(np.int64), np.zeros(len(starts), np.int64)]
            out["place"] += [(at[new] << 32) + crc, (starts << 32) + crc]
            out["end"] += [np.full(int(new.sum()), -1), ends]
            owner += [np.full(int(new.sum()) + len(starts), i)]
        if not owner:
            return None
        return {k: np.concatenate(v) for k, v in out.items()} | {"id": cols["id"].take(pa.array(np.concatenate(owner)))}

    return map_arrow(docs, of, f"gram bigint, around bigint, id {id_type}, place bigint, end int", keep=["id"], rows=TEXTS)


def repeats_before(ids: pa.Array) -> np.ndarray:
    """Whether each id but the first equals the one before it; nulls are equal."""
    no_id = pc.is_null(ids).to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (no_id[1:] & no_id[:-1])


def rows_of(ids: pa.Array, place: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(place, pa.int64()), pa.array(end, pa.int32())], names=["id", "place", "end"])


def _first_sort(places: DataFrame, id_type: str, length: int) -> DataFrame:
    """``id, place, end``: spans settled by the sort (``end`` given) and suffixes to refine (``end`` = -1).

    The rows are dealt by ranges of the sort key, which ends with the place: no bucket has to fit into a task. A bucket
    that a boundary cuts is not dropped, and a suffix right after a boundary is not settled; refinement decides both.
    """
    side = length - GRAM
    def run(batches):
        before = None  # last row of the batch before: gram, around, id, place, whether it is a span
        pending = None  # last suffix left so far, its bucket, and whether it has met another one
        first_bucket = None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, around, place, end = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("gram", "around", "place", "end"))
            ids = batch.column(batch.schema.get_field_index("id"))
            span = end >= 0
            last = before or (None, None, None, -1, True)
            same_id = np.concatenate([[last[2] == ids[0].as_py()], repeats_before(ids)])
            same = np.concatenate([[not last[4] and last[0] == gram[0] and last[1] == around[0]], (gram[1:] == gram[:-1]) & (around[1:] == around[:-1]) & ~span[:-1]]) & ~span
            place_before = np.concatenate([[last[3]], place[:-1]])
            copy = same & same_id & (place == place_before)
            settled = same & ~(same_id & (place >> 32 == place_before >> 32))
            before = (gram[-1], around[-1], ids[-1].as_py(), place[-1], bool(span[-1]))
            first_bucket = gram[0] if first_bucket is None else first_bucket
            rows = np.flatnonzero(span | settled)
            start = np.where(span[rows], place[rows] >> 32, np.maximum((place[rows] >> 32) - side, 0))
            yield rows_of(ids.take(pa.array(rows)), (start << 32) + (place[rows] & CRC), np.where(span[rows], end[rows], (place[rows] >> 32) + length))
            left = np.flatnonzero(~span & ~settled & ~copy)
            if not len(left):
                continue
            g = gram[left]
            next_too = np.concatenate([g[1:] == g[:-1], [False]])
            meets = next_too | np.concatenate([[False], next_too[:-1]]) | (g == first_bucket)
            if pending is not None:
                meets[0] |= pending[1] == g[0]
                if pending[2] or pending[1] == g[0]:
                    yield pending[0]
            chosen = left[np.flatnonzero(meets[:-1])]
            yield rows_of(ids.take(pa.array(chosen)), place[chosen], np.full(len(chosen), -1))
            pending = (rows_of(ids.take(pa.array(left[-1:])), place[left[-1:]], np.full(1, -1)), g[-1], bool(meets[-1]))
        if pending is not None:
            yield pending[0]

    key = ["gram", "around", "id", "place"]
    return places.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(run, f"id {id_type}, place bigint, end int")


def bucket_of(around: bytes, side: int, low: int, high: int) -> tuple[int, int]:
    """The bucket of strings with ``low`` to ``high`` bytes left of the gram: bounds and the bytes all of them hold."""
    h = xxhash.xxh3_128_digest(bytes([low, high]) + around[side - low : 2 * side + GRAM - high])
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def strings_of(around: np.ndarray, length: int) -> np.ndarray:
    """Hash of the string with 0, 1, ... bytes left of the gram, for every row of surroundings."""
    half = 1 << (length.bit_length() - 1)  # two such halves cover a string
    h, k = around.astype(np.uint64) + np.uint64(1), 1
    while k < half:
        h, k = mixed(h[:, :-k] * np.uint64(MULTIPLIER) + h[:, k:]), 2 * k
    each = np.arange(length - GRAM, -1, -1)
    return mixed(h[:, each] * np.uint64(MULTIPLIER) + h[:, each + length - half])


def _sort_buckets(rows: DataFrame, id_type: str, length: int) -> DataFrame:
    """Spans ``id, place, end`` of what stands earlier, for rows whose buckets fit into a task."""
    side = length - GRAM
    key = ["a", "b", "id", "place"]

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        a, b = (table.column(c).to_numpy() for c in ("a", "b"))
        opens = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        met = ~opens | ~np.append(opens[1:], True)  # not alone in its bucket
        if not met.any():
            return None
        table, opens = table.filter(pa.array(met)).combine_chunks(), opens[met]
        low, high, left, right, place = (table.column(c).to_numpy() for c in ("low", "high", "left", "right", "place"))
        ids = table.column("id").combine_chunks()
        at = place >> 32
        rank = np.cumsum(np.concatenate([[True], ~(repeats_before(ids) & (at[1:] == at[:-1]))]) | opens)  # of the place
        around = np.frombuffer(b"".join(table.column("around").to_pylist()), np.uint8).reshape(len(at), 2 * side + GRAM)
        strings = mixed(strings_of(around, length) + np.cumsum(opens).astype(np.uint64)[:, None] * np.uint64(MULTIPLIER))
        found = np.zeros((len(at), side + 3), bool)  # a column of False on either side
        for n in range(side + 1):
            has = np.flatnonzero((low <= n) & (n <= high) & (n <= left) & (side - n <= right))
            _, first, which = np.unique(strings[has, n], return_index=True, return_inverse=True)
            found[has, n + 1] = rank[has] > rank[has[first[which]]]
        row, low = np.nonzero(found[:, 1:-1] & ~found[:, :-2])
        _, high = np.nonzero(found[:, 1:-1] & ~found[:, 2:])
        return rows_of(ids.take(pa.array(row)), ((at[row] - high) << 32) + (place[row] & CRC), at[row] - low + length)

    def run(batches):
        held = []  # the last bucket may go on
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("a", "b"))
                ended = np.flatnonzero((a != a[-1]) | (b != b[-1]))
                cut = int(ended[-1]) + 1 if len(ended) else 0
                if held and (cut or (held[0].column(0)[0] != batch.column(0)[0] or held[0].column(1)[0] != batch.column(1)[0])):
                    out = settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = []
                else:
                    out = settle(pa.Table.from_batches([batch.slice(0, cut)])) if cut else None
                held.append(batch.slice(cut))
                if out is not None:
                    yield out
        if held and (out := settle(pa.Table.from_batches(held))) is not None:
            yield out

    columns = [*key, "low", "high", "left", "right", "around"]
    return rows.select(columns).repartition("a", "b").sortWithinPartitions(*key).mapInArrow(run, f"id {id_type}, place bigint, end int")


def _refine(rows: DataFrame, id_type: str, length: int, halve: bool) -> DataFrame:
    """One round over large buckets: ``a, b`` (bucket), ``id, place, low, high, left, right, around``, and spans in ``end``."""
    side = length - GRAM
    at = F.shiftright("place", 32)
    first = rows.groupBy("a", "b").agg(F.min(F.struct("id", "place", "left", "right", "around")).alias("f"), F.count("*").alias("n")).where("n > 1")
    earlier = ~(F.col("f.id").eqNullSafe(F.col("id")) & (F.shiftright("f.place", 32) == at))
    met = rows.join(first, ["a", "b"]).where(earlier).select(
        "id", "place", "low", "high", "left", "right", "around", F.col("f.left").alias("left0"), F.col("f.right").alias("right0"), F.col("f.around").alias("around0")
    )

    def of(cols):
        ids, around = cols["id"], cols["around"]
        n = len(around)
        place, low, high, left, right, left0, right0 = (np.array(cols[c], np.int64) for c in ("place", "low", "high", "left", "right", "left0", "right0"))
        differs = (np.frombuffer(b"".join(around), np.uint8) != np.frombuffer(b"".join(cols["around0"]), np.uint8)).reshape(n, 2 * side + GRAM)
        edge = np.ones((n, 1), bool)
        agree_left = np.minimum(np.argmax(np.concatenate([differs[:, :side][:, ::-1], edge], 1), 1), np.minimum(left, left0))
        agree_right = np.minimum(np.argmax(np.concatenate([differs[:, side + GRAM :], edge], 1), 1), np.minimum(right, right0))
        least, most = np.maximum(low, side - agree_right), np.minimum(high, agree_left)
        out = {c: [] for c in ("a", "b", "id", "place", "low", "high", "left", "right", "around", "end")}
        found = np.flatnonzero(least <= most)
        start = (place >> 32) - most
        out["id"] += [ids[i] for i in found.tolist()]
        out["place"] += ((start[found] << 32) + (place[found] & CRC)).tolist()
        out["end"] += ((place[found] >> 32) - least[found] + length).tolist()
        for c in ("a", "b", "low", "high", "left", "right", "around"):
            out[c] += [None] * len(found)
        for lows, highs in ((low, np.minimum(high, side - 1 - agree_right)), (np.maximum(low, agree_left + 1), high)):
            middle = (lows + highs) // 2 if halve else highs
            for lo, hi in ((lows, middle), (middle + 1, highs)):
                go = np.flatnonzero((lo <= hi) & (np.maximum(lo, side - right) <= np.minimum(hi, left)))
                for i, l, h in zip(go.tolist(), lo[go].tolist(), hi[go].tolist()):
                    a, b = bucket_of(around[i], side, l, h)
                    for c, v in zip(out, (a, b, ids[i], int(place[i]), l, h, int(left[i]), int(right[i]), around[i], -1)):
                        out[c].append(v)
        return out

    return map_arrow(met, of, ROWS.format(id=id_type), rows=16 * TEXTS)


ROWS = "a bigint, b bigint, id {id}, place bigint, low int, high int, left int, right int, around binary, end int"


def _lists(found: DataFrame) -> DataFrame:
    """Spans and suffixes per text: ``id, crc, x`` with a list of (start, end)."""
    crc = F.col("place").bitwiseAND(CRC)
    pair = F.struct(F.shiftright("place", 32).cast("int").alias("s"), F.col("end").alias("e"))
    return found.groupBy("id", crc.alias("crc")).agg(F.collect_list(pair).alias("x"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Every document without the bytes of ``length``-byte strings that also start earlier in the table.

    One row per input row: ``id, n_bytes, n_removed, n_spans, spans`` (starts and ends of the removed runs, disjoint,
    sorted), ``kept`` (the bytes left; null for a null text).
    """
    side = length - GRAM
    if not 0 < side < 128:
        raise ValueError("length must be between 33 and 159 bytes")
    id_type = docs.schema[id_col].dataType.simpleString()
    text = text_bytes(text_col)
    read = docs.select(F.col(id_col).alias("id"), F.crc32(F.coalesce(text, F.lit(b""))).alias("crc"), text.alias("text"))
    found = store(_first_sort(_places(read, id_type, length), id_type, length))

    def contexts(cols):
        out = {c: [] for c in ("a", "b", "id", "place", "low", "high", "left", "right", "around", "end")}
        for i, crc, data, xs in zip(cols["id"], cols["crc"], cols["text"], cols["x"]):
            for x in xs:
                at = x["s"]
                around = surroundings(data, at, side)
                for c, v in zip(out, (*bucket_of(around, side, 0, side), i, (at << 32) + crc, 0, side, min(at, side), min(len(data) - at - GRAM, side), around, -1)):
                    out[c].append(v)
        return out

    same = [F.col("d.id").eqNullSafe(F.col("x.id")), F.col("d.crc") == F.col("x.crc")]
    asked = read.alias("d").join(_lists(found.where("end < 0")).alias("x"), same).select("d.id", "d.crc", "d.text", "x.x")
    rows = store(map_arrow(asked, contexts, ROWS.format(id=id_type), rows=TEXTS))
    spans, turn = found.where("end >= 0"), 0
    while True:
        large = store(rows.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("a", "b"))
        some = not large.isEmpty()
        small = rows.join(large, ["a", "b"], "left_anti") if some else rows
        spans = spans.unionByName(store(_sort_buckets(small, id_type, length)))
        if not some:
            break
        out = store(_refine(rows.join(large, ["a", "b"], "left_semi"), id_type, length, turn >= PLAIN_ROUNDS))
        spans = spans.unionByName(out.where("end >= 0").select("id", "place", "end"))
        rows, turn = out.where("end < 0"), turn + 1

    def cut(cols):
        out = {c: [] for c in ("id", "n_bytes", "n_removed", "n_spans", "spans", "kept")}
        for i, data, xs in zip(cols["id"], cols["text"], cols["x"]):
            pairs = [(x["s"], min(x["e"], len(data))) for x in xs or ()]
            s, e = merged(*np.array(pairs or np.zeros((0, 2)), np.int64).reshape(-1, 2).T)
            bounds = [0, *np.stack([s, e], 1).ravel().tolist(), len(data or b"")]
            out["id"].append(i)
            out["n_bytes"].append(len(data or b""))
            out["n_removed"].append(int((e - s).sum()))
            out["n_spans"].append(len(s))
            out["spans"].append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
            out["kept"].append(None if data is None else b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
        return out

    schema = f"id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    both = read.alias("d").join(_lists(spans).alias("x"), same, "left").select("d.id", "d.text", "x.x")
    return map_arrow(both, cut, schema, rows=TEXTS).withColumnRenamed("id", id_col)
