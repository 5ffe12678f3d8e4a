"""Embedding near-duplicates by NN-descent.

A first neighbour graph comes from sorted random-hyperplane codes: in each of several tables a vector meets the few
next to it in code order. Rounds of neighbours-of-neighbours joins refine it: the vectors around each vector are
compared with one another. The graph keeps the closest ``neighbours`` of each vector, however far they are, and all
pairs within twice the threshold's angle, since two vectors within the threshold of a common one are no farther apart;
of a vector's pairs the closest ``neighbours`` take part in a round. Pairs at or above the threshold are links.

Bounded audit queries are compared with all vectors, only to measure: recall is the mean over queries that have links,
taken over all of them and over those outside large components. Half of the queries are drawn from all vectors, the
others from those for which a second set of tables, independent of the search and with a wider reach, shows links: so
sparse duplicates are measured too. While one recall is too low, tables and rounds are added. Only if the most tables
do not reach it are all vectors compared block by block, and one link per block and pair of components joins what the
search left apart. If neither the draw nor the second tables show a link, there is nothing to measure and the search
stands. The second tables' links join the result after the measurement, never the graph that is measured.

Where lists are saturated they are enlarged to the vector's whole component: the members of a component are compared
in blocks, which only yields counts. So the number of links has no cap and no group is listed pair by pair. Equal
vectors are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorform.llm._common import map_arrow, store
from priorform.llm.components import components

BLOCK = 1024
AUDIT_REACH = 4  # how many times wider the audit's own tables reach
CLOSEST = 4  # pairs below the floor that a vector in a list brings into the graph in a round


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; ``None`` if it is null, zero or not finite throughout."""
    if not vector or None in vector:
        return None
    v = np.asarray(vector, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or np.isnan(v).any() or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def _by_group(width: int, work: Callable[[tuple, list[list]], None], flush: Callable[[], pa.RecordBatch | None]):
    """A ``mapInArrow`` function over rows sorted by their first ``width`` columns: one call per whole group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:width] != key:
                    if rows:
                        work(key, rows)
                    key, rows = row[:width], []
                rows.append(row[width:])
            if (out := flush()) is not None:
                yield out
        if rows:
            work(key, rows)
        if (out := flush()) is not None:
            yield out

    return run


def _pairs_output() -> tuple[list, Callable[[], pa.RecordBatch | None]]:
    found: list[tuple] = []

    def flush():
        if not found:
            return None
        a, b, s = zip(*found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], names=["a", "b", "sim"])

    return found, flush


PAIR = "a binary, b binary, sim double"


def _table_pairs(classes: DataFrame, tables: range, bits: int, reach: int, floor: float, seed: int) -> DataFrame:
    """Pairs of vectors at most ``reach`` places apart in the code order of a table."""

    def codes(cols):
        out = {"t": [], "code": [], "along": [], "key": [], "v": []}
        for key, v in zip(cols["key"], cols["v"]):
            x = np.frombuffer(v)
            for t in tables:
                planes = np.random.default_rng([seed, t, len(x)]).normal(size=(bits + 1, len(x))) if (t, len(x)) not in made else made[t, len(x)]
                made[t, len(x)] = planes
                p = planes @ x
                code = 0
                for bit in p[:bits] > 0:
                    code = code << 1 | int(bit)
                for name, value in zip(out, (t, code, float(p[bits]), key, v)):
                    out[name].append(value)
        return out

    made: dict = {}

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, flush = _pairs_output()
        tail: list[tuple] = []
        for batch in batches:
            rows = tail + list(zip(*(c.to_pylist() for c in batch.columns)))
            groups: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                groups.setdefault(len(r[4]), []).append(i)
            for same in groups.values():
                x = np.stack([np.frombuffer(rows[i][4]) for i in same])
                for step in range(1, reach + 1):
                    sims = np.einsum("ij,ij->i", x[:-step], x[step:])
                    for k in np.flatnonzero(sims >= floor):
                        a, b = rows[same[k]], rows[same[k + step]]
                        if a[3] != b[3] and same[k + step] >= len(tail):
                            found.append((min(a[3], b[3]), max(a[3], b[3]), float(sims[k])))
            tail = rows[-reach:]
            if (out := flush()) is not None:
                yield out

    coded = map_arrow(classes.select("key", "v"), codes, "t int, code bigint, along double, key binary, v binary")
    order = coded.repartitionByRange("t", "code", "along").sortWithinPartitions("t", "code", "along")
    return order.mapInArrow(slide, PAIR).groupBy("a", "b").agg(F.max("sim").alias("sim"))


def _around(graph: DataFrame, classes: DataFrame, neighbours: int, floor: float) -> DataFrame:
    """Pairs among the closest neighbours of each vector."""
    both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    lists = both.withColumn("r", rank).where(F.col("r") <= neighbours).select("a", "b")
    met = lists.join(classes.select(F.col("key").alias("b"), "v"), "b").select("a", "b", "v")
    found, flush = _pairs_output()

    def work(_, rows):
        if len(rows) < 2:
            return
        x = np.stack([np.frombuffer(r[1]) for r in rows])
        sims = x @ x.T
        near = sims >= floor
        np.fill_diagonal(sims, -np.inf)
        best = np.argsort(-sims, axis=1, kind="stable")[:, : min(CLOSEST, len(rows) - 1)]
        near[np.arange(len(rows))[:, None], best] = True
        for i, j in zip(*np.nonzero(np.triu(near | near.T, 1))):
            a, b = rows[i][0], rows[j][0]
            found.append((min(a, b), max(a, b), float(x[i] @ x[j])))

    pairs = met.repartition("a").sortWithinPartitions("a").mapInArrow(_by_group(1, work, flush), PAIR)
    return pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def _kept(graph: DataFrame, neighbours: int, floor: float) -> DataFrame:
    """The closest neighbours of each vector and all pairs at or above the floor."""
    graph = graph.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    near = both.withColumn("r", rank).where((F.col("r") <= neighbours) | (F.col("sim") >= floor))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()


def _questions(classes: DataFrame, beside: DataFrame, asked: int, neighbours: int) -> list:
    """At most ``asked`` vectors with their keys: a half drawn by hash from all of them, the rest by hash from those that
    have links in ``beside``, those of few links first."""
    by_hash = F.xxhash64("key", F.lit(3))
    ends = beside.select(F.col("a").alias("key")).unionByName(beside.select(F.col("b").alias("key")))
    linked = ends.groupBy("key").agg((F.count(F.lit(1)) > neighbours).alias("many")).orderBy("many", by_hash).limit(asked - asked // 2)
    drawn = classes.select("key").orderBy(by_hash).limit(asked // 2)
    return classes.join(F.broadcast(linked.select("key").unionByName(drawn).distinct()), "key").select("key", "v").collect()


def _recalls(classes: DataFrame, labels: DataFrame, questions: list, threshold: float, small: int) -> tuple[float, float, int, int]:
    """Mean share of its links that a question knows, over all with links and over those in components of at most
    ``small`` classes, and how many of both kinds there are. A link is known if both ends are in one component.

    Every vector is compared with the questions; a task lists links only as counts by question and component.
    """
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for n in {len(r["v"]) for r in questions}:
        rows = [r for r in questions if len(r["v"]) == n]
        by_size[n] = ([bytes(r["key"]) for r in rows], np.stack([np.frombuffer(r["v"]) for r in rows]))
    shipped = classes.sparkSession.sparkContext.broadcast(by_size)

    def compare(cols):
        met: dict[tuple, int] = {}
        for n in {len(v) for v in cols["v"]} & shipped.value.keys():
            keys, q = shipped.value[n]
            mine = [(k, v, c) for k, v, c in zip(cols["key"], cols["v"], cols["comp"]) if len(v) == n]
            for at in range(0, len(mine), BLOCK):
                part = mine[at : at + BLOCK]
                sims = q @ np.stack([np.frombuffer(v) for _, v, _ in part]).T
                for i, j in zip(*np.nonzero(sims >= threshold)):
                    if keys[i] != part[j][0]:
                        met[keys[i], part[j][2]] = met.get((keys[i], part[j][2]), 0) + 1
        return {"a": [a for a, _ in met], "cb": [c for _, c in met], "n": list(met.values())}

    placed = classes.join(labels.select(F.col("node").alias("key"), "comp"), "key", "left").select("key", "v", "comp")
    links = map_arrow(placed, compare, "a binary, cb binary, n bigint").groupBy("a", "cb").agg(F.sum("n").alias("n"))
    sized = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    own = labels.join(sized, "comp").select(F.col("node").alias("a"), F.col("comp").alias("ca"), "m")
    known = F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0)
    answers = links.join(own, "a", "left").groupBy("a").agg((F.sum(known) / F.sum("n")).alias("r"), F.coalesce(F.max("m"), F.lit(1)).alias("m"))
    apart = F.col("m") <= small
    every, few, n, n_apart = answers.agg(F.avg("r"), F.avg(F.when(apart, F.col("r"))), F.count(F.lit(1)), F.count_if(apart)).first()
    return 1.0 if every is None else every, 1.0 if few is None else few, n, n_apart


def _left_apart(classes: DataFrame, labels: DataFrame, n: int, threshold: float) -> DataFrame:
    """All vectors block against block: a link for each two components that a block pair shows to be linked."""
    blocks = -(-n // (4 * BLOCK))
    placed = classes.join(labels.select(F.col("node").alias("key"), "comp"), "key", "left")
    mine = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(blocks)).cast("int")
    dealt = (
        placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(F.octet_length("v").alias("size"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", F.coalesce("comp", "key").alias("comp"), "v")
    )
    found, flush = _pairs_output()

    def work(key, rows):
        _, i, j = key
        sides = [[r for r in rows if r[0] == side] for side in ((i,) if i == j else (i, j))]
        if not all(sides):
            return
        left, right = sides[0], sides[-1]
        number: dict[bytes, int] = {}
        u, w = (np.array([number.setdefault(r[2], len(number)) for r in s]) for s in (left, right))
        y = np.stack([np.frombuffer(r[3]) for r in right])
        links = {}
        for at in range(0, len(left), BLOCK):
            sims = np.stack([np.frombuffer(r[3]) for r in left[at : at + BLOCK]]) @ y.T
            for p, q in zip(*np.nonzero((sims >= threshold) & (u[at : at + BLOCK, None] != w[None, :]))):
                a, b = left[at + p][1], right[q][1]
                links.setdefault((min(u[at + p], w[q]), max(u[at + p], w[q])), (min(a, b), max(a, b), float(sims[p, q])))
        found.extend(links.values())

    groups = dealt.repartition("size", "i", "j").sortWithinPartitions("size", "i", "j")
    return groups.mapInArrow(_by_group(3, work, flush), PAIR)


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """``key, links``: rows of other classes of the component at or above the threshold, block against block."""
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    placed = members.join(sizes, "comp").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")).cast("int")
    dealt = (
        placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "rows", "v")
    )
    totals: list[tuple] = []

    def flush():
        if not totals:
            return None
        keys, links = zip(*totals)
        totals.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(links, pa.int64())], names=["key", "links"])

    def work(key, rows):
        _, i, j = key
        sides = [[r for r in rows if r[0] == side] for side in ((i,) if i == j else (i, j))]
        if not all(sides):
            return
        left, right = sides[0], sides[-1]
        x, y = (np.stack([np.frombuffer(r[3]) for r in s]) for s in (left, right))
        near = (x @ y.T) >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        weight = lambda s: np.array([r[2] for r in s], np.int64)
        totals.extend(zip((r[1] for r in left), (near @ weight(right)).tolist()))
        if i != j:
            totals.extend(zip((r[1] for r in right), (near.T @ weight(left)).tolist()))

    groups = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return groups.mapInArrow(_by_group(3, work, flush), "key binary, links bigint").groupBy("key").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = 16,
    reach: int = 8, tables: int = 8, most_tables: int = 64, rounds: int = 3, audit: int = 1000, recall: float = 0.98, seed: int = 11,
) -> tuple[DataFrame, dict]:
    """``id, n_links, component_id`` per input row, and what the search measured.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths do not link. ``n_links`` counts the other rows found at a cosine of ``threshold`` or more,
    equal vectors included; ``component_id`` is the smallest id reachable. Repeated rows are rows of their own.
    The measurements hold the tables used, the audited recall of the search (mean over the ``audited`` queries that
    have links, of at most ``audit``), ``recall_apart`` over the ``audited_apart`` of them outside components of more
    than ``neighbours`` classes, and whether all vectors were compared (``exact``): only if a recall was measured
    below ``recall`` after ``most_tables``. After that, recalls are 1. This is one way for every number of vectors.
    Other columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def keyed(cols):
        units = [unit(v) for v in cols["v"]]
        return {
            "id": cols["id"],
            "key": [None if u is None else hashlib.blake2b(np.asarray(v, np.float64).tobytes(), digest_size=16).digest() for u, v in zip(units, cols["v"])],
            "v": [None if u is None else u.tobytes() for u in units],
        }

    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    facts = store(map_arrow(source, keyed, f"id {kind}, key binary, v binary"))
    classes = store(facts.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("v").alias("v")))
    n = classes.count()
    told = {"classes": n, "tables": 0, "recall": 1.0, "recall_apart": 1.0, "audited": 0, "audited_apart": 0, "exact": False}
    if n < 2:
        graph = None
    else:
        bits = max(1, int(np.log2(n / 32)) if n > 64 else 1)
        floor = max(threshold * 2 * threshold - 1, -1.0)
        second = _table_pairs(classes, range(most_tables, most_tables + tables), min(bits, 62), AUDIT_REACH * reach, threshold, seed)
        beside = store(second.select("a", "b"))
        questions = _questions(classes, beside, audit, neighbours)
        graph = None
        while True:
            fresh = _table_pairs(classes, range(told["tables"], told["tables"] + tables), min(bits, 62), reach, -1.0, seed)
            told["tables"] += tables
            graph = store(_kept(fresh if graph is None else graph.unionByName(fresh), neighbours, floor))
            known = graph.agg(F.sum(1 + F.col("sim"))).first()[0] or 0.0
            for _ in range(rounds):
                graph = store(_kept(graph.unionByName(_around(graph, classes, neighbours, floor)), neighbours, floor))
                before, known = known, graph.agg(F.sum(1 + F.col("sim"))).first()[0] or 0.0
                if known - before <= 0.001 * known:
                    break
            links = graph.where(F.col("sim") >= threshold).select("a", "b")
            labels = components(links)
            told["recall"], told["recall_apart"], told["audited"], told["audited_apart"] = _recalls(classes, labels, questions, threshold, neighbours)
            reached = min(told["recall"], told["recall_apart"]) >= recall
            if reached or told["tables"] >= most_tables:
                break
        links = links.unionByName(beside)
        if not reached:
            told |= {"exact": True, "recall": 1.0, "recall_apart": 1.0}
            links = links.unionByName(store(_left_apart(classes, labels, n, threshold)).select("a", "b"))
        labels = components(links)
    if graph is None:
        named = classes.select("key", F.col("least").alias("component_id"), F.lit(0).cast("bigint").alias("links"), "rows")
    else:
        members = store(classes.join(labels.select(F.col("node").alias("key"), "comp"), "key"))
        least = members.groupBy("comp").agg(F.min("least").alias("component_id"))
        linked = members.join(_counted(members, threshold), "key").join(least, "comp")
        named = classes.join(linked.select("key", "component_id", "links"), "key", "left").select(
            "key", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"), "rows"
        )
    out = facts.select("id", "key").join(named, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("rows") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out, told
