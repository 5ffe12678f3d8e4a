"""Ranked lexical search over an index whose strata are the documents of one normaliser.

A term's share of a score depends on its frequency in the document and on the document's normaliser ``m`` alone, apart from
the term's weight. The index therefore groups documents by equal ``m``; within such a stratum the postings of a term lie by
frequency, and the impact ``SCALE * tf div (1000 * tf + 12 * m)`` is computed once per frequency, not per posting. Large
strata are stored in several blocks. A search bounds each item's score in a block by the largest frequencies there, visits
the blocks of a batch in the order of these bounds, and leaves out every block that cannot reach the item's last place.
Scores are sums of whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from priorform.llm._common import WORD_BYTES, WordHashes, map_arrow, store, text_bytes

SCALE = 1_000_000_000
BLOCK = 2048  # documents of a block at most
PART = 1 << 14  # documents of a part of a stratum, about
POSTINGS = 1 << 19  # and about so many postings
ITEMS, TERMS = 256, 1 << 14  # of the items that are asked together; larger query sets go over the index in turns
EXACT = 1 << 53  # up to here sums of whole numbers in doubles are exact


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


@dataclass
class Index:
    """Blocks ``m, ids, term, tf, size, docs``, the number of documents with terms and that of all terms."""

    blocks: DataFrame
    documents: int
    terms: int


def _forward(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, term, tf``: number of terms, distinct term hashes and their frequencies, per document with terms."""
    hashes = WordHashes()

    def of(cols):
        lengths, sizes, terms, tfs, rows = [], [], [], [], []
        for i, text in enumerate(cols["text"]):
            words = terms_of(text)
            if words:
                counted = Counter(words)
                rows.append(i)
                lengths.append(len(words))
                sizes.append(len(counted))
                terms.append(hashes.of(list(counted)).view(np.int64))
                tfs.append(np.fromiter(counted.values(), np.int32, len(counted)))
        if not rows:
            return None
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return {
            "id": cols["id"].take(pa.array(rows)), "n": lengths,
            "term": pa.ListArray.from_arrays(offsets, np.concatenate(terms)), "tf": pa.ListArray.from_arrays(offsets, np.concatenate(tfs)),
        }

    read = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return map_arrow(read, of, f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, term array<bigint>, tf array<int>", keep=["id"], rows=1024)


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 25) -> Index:
    """The index of all documents, all terms; null texts and texts without a term are no documents of it.

    ``m = 100 - share + (share * n * N) div L`` with a document's number of terms ``n``, that of all terms ``L``, and the
    number of documents ``N``. Documents are dealt by ``m`` and a part of it, and there are as many parts as keep any stratum
    at about ``PART`` documents a part: strata of any size are spread over tasks, and so are long documents.
    """
    forward = store(_forward(docs, id_col, text_col))
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"cast({100 - share} + ({share} * n * {n_docs}) div {max(n_terms, 1)} as bigint)")
    part = F.pmod(F.xxhash64("id", F.col("term")[0]), F.lit(n_docs // PART + 1))
    dealt = forward.select(m.alias("m"), "id", "term", "tf").repartition("m", part).sortWithinPartitions("m", "id")
    id_type = docs.schema[id_col].dataType.simpleString()

    def block(m, parts):
        ids = pa.concat_arrays([p[0] for p in parts])
        sizes, term, tf = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.lexsort((tf, term))
        term, tf, owner = term[order], tf[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
        lists = [ids, term[first], tf[first], np.diff(np.append(first, len(term))).astype(np.int32), owner]
        return pa.RecordBatch.from_arrays(
            [pa.array([m], pa.int64())] + [pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x if isinstance(x, pa.Array) else pa.array(x)) for x in lists],
            names=["m", "ids", "term", "tf", "size", "docs"],
        )

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, weight = None, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ms = batch.column(0).to_numpy()
            ids, terms, tfs = batch.column(1), batch.column(2), batch.column(3)
            offsets = terms.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            at = 0
            while at < len(ms):
                if now != ms[at] or held >= BLOCK or weight >= POSTINGS:
                    if parts:
                        yield block(now, parts)
                    now, parts, held, weight = ms[at], [], 0, 0
                most = at + min(BLOCK - held, int(np.searchsorted(ms[at:], now, "right")))
                to = max(at + 1, min(most, int(np.searchsorted(offsets, offsets[at] + POSTINGS - weight, "right")) - 1))
                parts.append((ids.slice(at, to - at), np.diff(offsets[at : to + 1]), term[offsets[at] : offsets[to]], tf[offsets[at] : offsets[to]]))
                held, weight, at = held + to - at, weight + int(offsets[to] - offsets[at]), to
        if parts:
            yield block(now, parts)

    return Index(store(dealt.mapInArrow(invert, f"m bigint, ids array<{id_type}>, term array<bigint>, tf array<int>, size array<int>, docs array<int>")), n_docs, n_terms)


def _turns(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[Row, Counter]]]:
    """Items with terms, in lists of bounded size."""
    hashes = WordHashes()
    turn, terms = [], set()
    for row in items.select(F.col(item_col).alias("item"), text_bytes(text_col).alias("text")).distinct().toLocalIterator():
        counted = Counter(hashes.of(terms_of(row["text"])).view(np.int64).tolist())
        if counted:
            if turn and (len(turn) >= ITEMS or len(terms) + len(counted) > TERMS):
                yield turn
                turn, terms = [], set()
            turn.append((row["item"], counted))
            terms.update(counted)
    if turn:
        yield turn


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch."""
    lists = [batch.column(i) for i in range(1, batch.num_columns)]
    offsets = [x.offsets.to_numpy() - x.offsets[0].as_py() for x in lists]
    flat = [x.flatten() for x in lists]
    for i, m in enumerate(batch.column(0).to_pylist()):
        ids, *numbers = (v.slice(o[i], o[i + 1] - o[i]) for v, o in zip(flat, offsets))
        yield m, ids, *(v.to_numpy() for v in numbers)


def search(index: Index, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """Each item's ``k`` documents of highest score above 0: ``item, rank, id, score``; equal scores by id, null ids first.

    Items without a term, null ones too, give no row; rows that share item and text are one item. Rows of documents that
    share an id are ranked each. Scores are exact; term hashes of 64 bits stand for terms.
    """
    spark, id_type = index.blocks.sparkSession, index.blocks.schema["ids"].dataType.elementType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item {item_type}, rank int, id {id_type}, score bigint")
    for turn in _turns(items, item_col, text_col):
        found = found.unionByName(_ask(index, turn, item_type, id_type, k))
    return found.select(F.col("item").alias(item_col), "rank", "id", "score")


def _ask(index: Index, turn: list, item_type: str, id_type: str, k: int) -> DataFrame:
    spark = index.blocks.sparkSession
    vocabulary = np.array(sorted(set().union(*(c for _, c in turn))), np.int64)

    def frequencies(cols):
        total = np.zeros(len(vocabulary), np.int64)
        term, size = (cols[c].flatten().to_numpy() for c in ("term", "size"))
        at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        known = vocabulary[at] == term
        np.add.at(total, at[known], size[known])
        used = np.flatnonzero(total)
        return {"t": used, "df": total[used]}

    counted = map_arrow(index.blocks.select("term", "size"), frequencies, "t int, df bigint", keep=["term", "size"])
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.groupBy("t").agg(F.sum("df").alias("df")).collect():  # at most TERMS, or one item's terms
        df[r["t"]] = r["df"]
    weight = [math.floor(1000 * math.log((2 * index.documents + 2) / (2 * d + 1))) for d in df.tolist()]
    wanted = np.zeros((len(turn), len(vocabulary)), np.int64)
    place = {int(t): i for i, t in enumerate(vocabulary)}
    for row, (_, terms) in zip(wanted, turn):
        for t, n in terms.items():
            row[place[t]] = n * weight[place[t]]
    if wanted.sum(1).max(initial=0) * (SCALE // 1000) < EXACT:
        wanted = wanted.astype(np.float64)  # products by the processor's matrix units; sums stay exact
    shipped = spark.sparkContext.broadcast((vocabulary, wanted))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, wanted = shipped.value
        best: list[list[tuple]] = [[] for _ in wanted]  # (-score, has an id, id) of each item, at most k, in order
        last = np.ones(len(wanted), np.int64)  # the least score that still counts
        for batch in batches:
            blocks = []
            for m, ids, term, tf, size, docs in _rows(batch):
                at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[at] == term)
                if len(known):
                    t, f = at[known], tf[known].astype(np.int64)
                    impact = SCALE * f // (1000 * f + 12 * m)
                    top = np.flatnonzero(np.append(t[1:] != t[:-1], True))  # a term's largest frequency
                    bound = wanted[:, t[top]] @ impact[top].astype(wanted.dtype)
                    ends = np.cumsum(size.astype(np.int64))
                    blocks.append((bound, ids, t, t[top], impact, size[known], ends[known], docs))
            for bound, ids, t, used, impact, size, ends, docs in sorted(blocks, key=lambda b: -b[0].max()):
                asked = np.flatnonzero(bound >= last)
                if not len(asked):
                    continue
                row = np.searchsorted(used, t)
                shares = np.zeros((len(used), len(ids)), wanted.dtype)
                where = np.repeat(ends - np.cumsum(size), size) + np.arange(int(size.sum()))
                shares[np.repeat(row, size), docs[where]] = np.repeat(impact, size)
                scores = (wanted[np.ix_(asked, used)] @ shares).astype(np.int64)
                for item, s in zip(asked.tolist(), scores):
                    high = np.flatnonzero(s >= last[item])
                    if len(high):
                        if len(high) > k:
                            high = high[np.lexsort((high, -s[high]))[:k]]
                        more = [(-x, i is not None, i) if i is not None else (-x, False, 0) for x, i in zip(s[high].tolist(), ids.take(pa.array(high)).to_pylist())]
                        best[item] = sorted(best[item] + more)[:k]
                        if len(best[item]) == k:
                            last[item] = -best[item][-1][0]
        rows = [(n, i if has else None, -x) for n, one in enumerate(best) for x, has, i in one]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], target), pa.array([r[2] for r in rows], pa.int64())], names=["no", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    target = to_arrow_type(index.blocks.schema["ids"].dataType.elementType)
    scored = index.blocks.mapInArrow(visit, f"no int, id {id_type}, score bigint")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # of each item, k rows of a task
    names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(turn)], f"no int, item {item_type}")
    return ranked.join(F.broadcast(names), "no").select("item", "rank", "id", "score")  # at most ITEMS rows
