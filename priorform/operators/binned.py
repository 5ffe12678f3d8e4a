"""Binned response: difference with the mean of the response, in one and two dimensions.

Per non-empty bin: (bin mean - population mean)^2 / bin count; a predictor's value is the
average over its non-empty bins, unweighted and weighted by the bin's share.

Bin edges and population means are the only things the driver sees (one aggregate). All
predictors, or all pairs of predictors, then go through one grouping of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorform.operators.cleaning import plain_double
from priorform.operators.literals import literal_rows
from priorform.operators.summaries import bin_number, extremes, grid_edges

BINS = 10
INF = float("inf")
# Columns per row of a block in the pair grouping, see pair_cells.
BLOCK_HALF = 2


def equal_width_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Lower edges per column over its non-missing values."""
    return {c: grid_edges(*span, bins) if span else [] for c, span in extremes(df, columns).items()}


def bin_of(df: DataFrame, column: str, edges: Sequence[float]) -> Column:
    """1-based equal-width bin of a column, NULL for a missing value."""
    if not edges:
        return F.lit(None).cast("int")
    return bin_number(plain_double(df, column), edges)


def _response(df: DataFrame, response: str | Column) -> Column:
    return plain_double(df, response) if isinstance(response, str) else response


def dmr_1d(
    df: DataFrame, cats: Sequence[str], conts: Sequence[str], response: str | Column
) -> tuple[DataFrame, DataFrame]:
    """Bins and averages of every predictor against the response.

    A category has one bin per level, a number ten bins of equal width. Rows with a missing
    predictor or response are left out, predictor by predictor.

    Returns (bins, summary): bins are (predictor, bin, level, lower, upper, center, n, mean,
    pop_mean, msd, share, msd_weighted) with ``bin`` from 0 for numbers and NULL for
    categories; summary is (predictor, dmr, wdmr).
    """
    names = [*cats, *conts]
    y = _response(df, response)
    rows = df.select(*[F.col(c) for c in names], y.alias("__y")).where(F.col("__y").isNotNull())

    aggs = []
    for i, c in enumerate(names):
        v = F.col(c) if c in cats else plain_double(rows, c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(F.when(v.isNotNull(), F.col("__y"))).alias(f"m{i}")]
        if c in conts:
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    facts = rows.agg(*aggs).first()

    population = [(c, facts[f"n{i}"], facts[f"m{i}"]) for i, c in enumerate(names) if facts[f"n{i}"]]
    if not population:
        raise ValueError("no predictor has values where the response has")
    usable = {c for c, _, _ in population}
    grid, bins_of, values_of = [], [], []
    for i, c in enumerate(names):
        if c not in usable or c in cats:
            continue
        edges = grid_edges(facts[f"lo{i}"], facts[f"hi{i}"], BINS)
        width = (facts[f"hi{i}"] - facts[f"lo{i}"]) / BINS
        value = plain_double(rows, c)
        bins_of.append((c, bin_number(value, edges) - 1))
        values_of.append(value)
        for b, edge in enumerate(edges):
            step = width if b < BINS - 1 else INF
            grid.append((c, b, edge, edge + step, (edge + step) / 2 + edge))
    levels_of = [(c, F.col(c).cast("string")) for c in cats if c in usable]
    spark = df.sparkSession

    def named_keys(entries, name: str) -> tuple[DataFrame, Column]:
        """One row per predictor and row; arrays keep the expression small enough to be compiled."""
        arrays = [F.array(*[e for _, e in entries]).alias("__keys")]
        arrays += [F.array(*values_of).alias("__values")] if name == "bin" else []
        long = rows.select("__y", *arrays).select(
            "__y", *(["__values"] if name == "bin" else []), F.posexplode("__keys").alias("__at", name)
        )
        return long.where(F.col(name).isNotNull()), F.get(F.array(*[F.lit(c) for c, _ in entries]), F.col("__at"))

    cells = None
    if bins_of:
        long, predictor = named_keys(bins_of, "bin")
        value = F.get("__values", F.col("__at"))
        cells = long.groupBy("__at", "bin").agg(
            F.count(F.lit(1)).alias("n"), F.sum("__y").alias("__sum"), F.min(value).alias("__lo"), F.max(value).alias("__hi")
        ).withColumn("predictor", predictor)
    named = None
    if levels_of:
        long, predictor = named_keys(levels_of, "level")
        named = long.groupBy("__at", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("__sum"))
        named = named.withColumn("predictor", predictor).drop("__at").withColumns(
            {c: F.lit(None).cast("double") for c in ("__lo", "__hi", "__edge", "__top", "center")}
        ).withColumn("bin", F.lit(None).cast("int"))
    # Both constant tables have at most ten rows per predictor.
    edge_rows = literal_rows(
        spark,
        [("predictor", "string"), ("bin", "int"), ("__edge", "double"), ("__top", "double"), ("center", "double")],
        grid,
    )
    totals = literal_rows(
        spark, [("predictor", "string"), ("__total", "bigint"), ("pop_mean", "double")], population
    )
    parts = [named] if named is not None else []
    if cells is not None:
        numbered = edge_rows.join(cells.drop("__at"), on=["predictor", "bin"], how="left")
        parts.append(numbered.withColumn("level", F.lit(None).cast("string")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    bins = _score_bins(every.join(F.broadcast(totals), on="predictor"))
    return bins, summarize_bins(bins)


def _score_bins(cells: DataFrame, weight_inverse: bool = False) -> DataFrame:
    n = F.coalesce(F.col("n"), F.lit(0))
    filled = n > 0
    share = n / F.col("__total")
    mean = F.when(filled, F.col("__sum") / n)
    diff = mean - F.col("pop_mean")
    msd = F.when(filled, diff * diff / n)
    weighted = msd / F.when(filled, share) if weight_inverse else msd * share
    return cells.select(
        "predictor",
        "bin",
        "level",
        F.coalesce("__lo", "__edge").alias("lower"),
        F.coalesce("__hi", "__top").alias("upper"),
        "center",
        n.cast("bigint").alias("n"),
        mean.alias("mean"),
        "pop_mean",
        msd.alias("msd"),
        share.alias("share"),
        weighted.alias("msd_weighted"),
    )


def summarize_bins(bins: DataFrame) -> DataFrame:
    """(predictor, dmr, wdmr): averages over the non-empty bins."""
    return bins.groupBy("predictor").agg(
        F.avg("msd").alias("dmr"), F.avg("msd_weighted").alias("wdmr")
    )


def dmr_1d_adaptive(
    df: DataFrame, predictors: Sequence[str], response: str | Column
) -> tuple[DataFrame, DataFrame]:
    """The older binning: each bin starts at the largest value seen in the bin before.

    A boundary value is in both bins, a gap wider than the step leaves the bound in place,
    and the weighted figure divides by the share. Shapes as in :func:`dmr_1d`.

    The bounds follow from one another, so they take nine small aggregates ("largest value
    below bound + step") for all predictors together, then one aggregate for all bins.
    """
    y = _response(df, response)
    rows = df.select(*[plain_double(df, c).alias(c) for c in predictors], y.alias("__y"))
    rows = rows.where(F.col("__y").isNotNull())
    first = rows.agg(
        *[f(c).alias(f"{k}{i}") for i, c in enumerate(predictors) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))],
        *[F.avg(F.when(F.col(c).isNotNull(), F.col("__y"))).alias(f"m{i}") for i, c in enumerate(predictors)],
    ).first()
    at = {i: c for i, c in enumerate(predictors) if first[f"n{i}"]}
    if not at:
        raise ValueError("no predictor has values where the response has")
    step = {i: (first[f"hi{i}"] - first[f"lo{i}"]) / BINS for i in at}
    starts: dict[int, list[float]] = {i: [first[f"lo{i}"]] for i in at}
    for _ in range(BINS - 1):
        probe = rows.agg(
            *[
                F.max(F.when((F.col(c) >= starts[i][-1]) & (F.col(c) < starts[i][-1] + step[i]), F.col(c))).alias(f"b{i}")
                for i, c in at.items()
            ]
        ).first()
        for i in at:
            bound = probe[f"b{i}"]
            # An empty bin ends at its own upper edge.
            starts[i].append(starts[i][-1] + step[i] if bound is None else bound)

    entries = []
    for i, c in at.items():
        v = F.col(c)
        for b, lo in enumerate(starts[i]):
            hi = lo + (step[i] if b < BINS - 1 else INF)
            inside = v >= lo if b == BINS - 1 else (v >= lo) & (v < hi)
            entries.append((c, b, lo, hi, inside, first[f"n{i}"], first[f"m{i}"]))
    aggs = []
    for k, (c, b, lo, hi, inside, _, _) in enumerate(entries):
        aggs += [
            F.count_if(inside).alias(f"n{k}"),
            F.sum(F.when(inside, F.col("__y"))).alias(f"s{k}"),
            F.min(F.when(inside, F.col(c))).alias(f"l{k}"),
            F.max(F.when(inside, F.col(c))).alias(f"h{k}"),
        ]
    table = F.array(
        *[
            F.struct(
                F.lit(c).alias("predictor"),
                F.lit(b).alias("bin"),
                F.lit(None).cast("string").alias("level"),
                F.col(f"l{k}").alias("__lo"),
                F.col(f"h{k}").alias("__hi"),
                F.lit(lo).alias("__edge"),
                F.lit(hi).alias("__top"),
                F.coalesce(
                    (F.col(f"h{k}") - F.col(f"l{k}")) / 2 + F.col(f"l{k}"), F.lit(hi / 2 + lo)
                ).alias("center"),
                F.col(f"n{k}").alias("n"),
                F.col(f"s{k}").alias("__sum"),
                F.lit(total).cast("bigint").alias("__total"),
                F.lit(mean).alias("pop_mean"),
            )
            for k, (c, b, lo, hi, _, total, mean) in enumerate(entries)
        ]
    )
    bins = _score_bins(rows.agg(*aggs).select(F.inline(table)), weight_inverse=True)
    return bins, summarize_bins(bins)


def _blocks(pairs: Sequence[tuple[str, str]]) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """Cover column pairs by blocks of up to four columns.

    Columns are put in groups of two and a block is the union of two groups, so one grouped
    row serves up to six pairs. Returns (columns, [(pair id, position, position)]).
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    group = {c: i // BLOCK_HALF for i, c in enumerate(cols)}
    members: dict[int, list[str]] = {}
    for c in cols:
        members.setdefault(group[c], []).append(c)
    last = max(group.values(), default=0)
    blocks: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(pairs):
        g = tuple(sorted((group[a], group[b])))
        if g[0] == g[1]:
            g = (g[0], g[0] + 1) if g[0] < last else (max(0, g[0] - 1), g[0])
        blocks.setdefault(g, []).append(i)
    out = []
    for (g, h), ids in sorted(blocks.items()):
        columns = members[g] + (members[h] if h != g else [])
        where = {c: k for k, c in enumerate(columns)}
        out.append((columns, [(i, where[pairs[i][0]], where[pairs[i][1]]) for i in ids]))
    return out


def pair_cells(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    codes: dict[str, Column],
    response: Column,
    *,
    blocked: bool = True,
) -> DataFrame:
    """(pair, a, b, n, n_response, sum_response) for all pairs of coded columns, in one job.

    ``pair`` is the position in ``pairs``; a missing code is a NULL level. Each row is
    expanded to one entry per block (or per pair when ``blocked`` is off, which suits
    columns with very many levels) and combined before the shuffle to at most the cells
    that occur.
    """
    return _cells_by_block(df, pairs, codes, response) if blocked else _cells_by_pair(df, pairs, codes, response)


def number_cells(
    df: DataFrame, pairs: Sequence[tuple[str, str]], edges: dict[str, list[float]], response: Column
) -> DataFrame:
    """As :func:`pair_cells` for pairs of numbers: a task bins its rows by the edges and counts all pairs' cells in arrays.

    A task's sums have a fixed size, and the shuffle sees its cells once. The expressions of many bins in one plan are too
    large for the JVM to compile.
    """
    used = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(used)}
    bounds = [np.array(edges[c][1:], np.float64) if edges[c] else None for c in used]
    wide = max([BINS, *(len(edges[c]) for c in used)]) + 1  # codes: 0 is missing
    rows = df.select(F.array(*[plain_double(df, c) for c in used]).alias("values"), response.cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(pairs), 3, wide * wide))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(used))
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False).astype(np.float64)
            y = np.where(known > 0, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
            codes = np.zeros((len(used), len(values)), np.int64)
            for i, b in enumerate(bounds):
                if b is not None:
                    codes[i] = np.where(np.isnan(values[:, i]), 0, np.searchsorted(b, values[:, i], "right") + 1)
            for k, (x, z) in enumerate(pairs):
                cell = codes[at[x]] * wide + codes[at[z]]
                for j, weights in enumerate((None, known, y)):
                    sums[k, j] += np.bincount(cell, weights, wide * wide)
        pair, cell = np.nonzero(sums[:, 0])
        level = lambda code: pa.array([str(v) if v else None for v in code.tolist()], pa.string())
        n, ny, s = sums[pair, :, cell].T
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair.astype(np.int32)), level(cell // wide), level(cell % wide), pa.array(n.astype(np.int64)), pa.array(ny.astype(np.int64)), pa.array(np.where(ny > 0, s, np.nan), mask=ny == 0)],
            names=["pair", "a", "b", "n", "ny", "s"],
        )

    return _merge_cells(rows.mapInArrow(run, "pair int, a string, b string, n bigint, ny bigint, s double"))


def _cell_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count("__y").alias("ny"), F.sum("__y").alias("s")]


def _merge_cells(flat: DataFrame) -> DataFrame:
    return flat.groupBy("pair", "a", "b").agg(
        F.sum("n").alias("n"), F.sum("ny").alias("n_response"), F.sum("s").alias("sum_response")
    )


def _cells_by_pair(df, pairs, codes, response) -> DataFrame:
    """Positions of pairs are exploded, levels looked up: the code does not grow with the pairs."""
    used = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(used)}
    first, second = (F.array(*[F.lit(at[p[side]]) for p in pairs]) for side in (0, 1))
    long = df.select(F.array(*[codes[c].cast("string") for c in used]).alias("__levels"), response.alias("__y")).select(
        "__y", "__levels", F.explode(F.array(*[F.lit(i) for i in range(len(pairs))])).alias("pair")
    )
    a, b = (F.get("__levels", F.get(side, F.col("pair"))) for side in (first, second))
    return (
        long.groupBy("pair", a.alias("a"), b.alias("b"))
        .agg(*_cell_sums())
        .withColumnsRenamed({"ny": "n_response", "s": "sum_response"})
    )


def _cells_by_block(df, pairs, codes, response) -> DataFrame:
    """The bins of a block's columns are packed into one number, four bits each (0 is missing)."""
    blocks = _blocks(pairs)
    used = list(dict.fromkeys(c for cols, _ in blocks for c in cols))
    names = {c: f"__k{i}" for i, c in enumerate(used)}
    packed = []
    for cols, _ in blocks:
        code = F.lit(0)
        for c in reversed(cols):
            code = code * 16 + F.col(names[c])
        packed.append(code)
    cells = (
        df.select(*[F.coalesce(codes[c].cast("int"), F.lit(0)).alias(names[c]) for c in used], response.alias("__y"))
        .select("__y", F.array(*packed).alias("__codes"))
        .select("__y", F.posexplode("__codes").alias("block", "code"))
        .groupBy("block", "code")
        .agg(*_cell_sums())
    )
    wanted = F.array(
        *[
            F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(16**a).alias("ua"), F.lit(16**b).alias("ub")) for i, a, b in ids])
            for _, ids in blocks
        ]
    )

    def level(unit: str) -> Column:
        digit = F.floor(F.col("code") / F.col(unit)) % 16
        return F.when(digit > 0, digit.cast("int").cast("string"))

    return _merge_cells(
        cells.select("code", "n", "ny", "s", F.inline(F.get(wanted, F.col("block")))).select(
            "pair", level("ua").alias("a"), level("ub").alias("b"), "n", "ny", "s"
        )
    )


def population(df: DataFrame, response: Column) -> tuple[int, float | None]:
    """(rows, mean response): what two-dimensional cells are compared with."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.avg(response).alias("m")).first()
    return row["n"], row["m"]


def cell_table(cells: DataFrame, total: int, mean: float | None) -> DataFrame:
    """(pair, a, b, n, mean, share, dmr, wdmr) of the cells with both levels known."""
    known = cells.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    cell_mean = F.col("sum_response") / F.nullif(F.col("n_response"), F.lit(0))
    diff = cell_mean - F.lit(mean).cast("double")
    share = F.col("n") / F.lit(max(total, 1))
    dmr = diff * diff / F.col("n")
    return known.select(
        "pair", "a", "b", "n", cell_mean.alias("mean"), share.alias("share"), dmr.alias("dmr"), (dmr * share).alias("wdmr")
    )


def dmr_2d(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    kinds: dict[str, str],
    response: str | Column,
    *,
    edges: dict[str, list[float]] | None = None,
    totals: tuple[int, float | None] | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """(x, y, dmr, wdmr) for every pair of predictors.

    ``kinds`` says "cat" or "cont" per column. Rows with a missing predictor are in no cell
    but count in the population.
    """
    response = _response(df, response)
    total, mean = totals or population(df, response)
    if cells is None and is_binned(pairs, kinds):
        used = list(dict.fromkeys(c for p in pairs for c in p))
        cells = number_cells(df, pairs, edges or equal_width_edges(df, used), response)
    elif cells is None:
        cells = pair_cells(df, pairs, codes_for(df, kinds, edges), response, blocked=False)
    scored = (
        cell_table(cells, total, mean)
        .groupBy("pair")
        .agg(F.avg("dmr").alias("dmr"), F.avg("wdmr").alias("wdmr"))
    )
    return name_pairs(scored, pairs).select("x", "y", "dmr", "wdmr")


def is_binned(pairs: Sequence[tuple[str, str]], kinds: dict[str, str]) -> bool:
    """Only binned columns have a bounded number of levels, which blocks rely on."""
    return all(kinds[c] == "cont" for p in pairs for c in p)


def codes_for(
    df: DataFrame, kinds: dict[str, str], edges: dict[str, list[float]] | None = None
) -> dict[str, Column]:
    """Level text per category, bin number per continuous column."""
    conts = [c for c, k in kinds.items() if k == "cont"]
    edges = edges or (equal_width_edges(df, conts) if conts else {})
    return {c: bin_of(df, c, edges[c]) if k == "cont" else F.col(c) for c, k in kinds.items()}


def name_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Add columns x and y from the position in ``pairs``."""
    names = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    return df.withColumn("__p", F.get(names, F.col("pair"))).select("*", "__p.x", "__p.y").drop("__p")


def dense_cells(
    df: DataFrame, x: str, y: str, kinds: dict[str, str], response: str | Column
) -> DataFrame:
    """(a, b, n, mean, share) of one pair over all cells; an empty cell has share 0 and no mean."""
    response = _response(df, response)
    total, mean = population(df, response)
    codes = codes_for(df, kinds)
    cells = cell_table(pair_cells(df, [(x, y)], codes, response, blocked=False), total, mean)

    def axis(c: str) -> Column:
        """All levels as one array: numbers have their bins, categories what a distinct finds."""
        if kinds[c] == "cont":
            return F.array(*[F.lit(str(b)) for b in range(1, BINS + 1)])
        return F.array_sort(F.collect_set(F.col(c).cast("string")))

    # The grid is the output's own size, levels by levels.
    lists = df.agg(*[axis(c).alias(n) for n, c in (("a", x), ("b", y))])
    grid = lists.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    return grid.join(cells, on=["a", "b"], how="left").select(
        "a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "mean",
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )


def all_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))
