"""Pairs of predictors as data: products of one-hot bins per block of rows, added up by partition and merged by key.

A block's numbers become a matrix of bins, one column of zeros and ones per predictor and bin. Its product with itself
holds the counts of all cells of all pairs at once, the product weighted by the response their sums, and that of the
centred values the sums a correlation needs. A partition hands on its cells once, and cells are merged by (x, y, a, b).
The plan has one column per predictor and nothing per pair. A pass takes the pairs of two tiles of ``TILE`` columns, so
that a task's sums keep a fixed size whatever the number of predictors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from priorform.operators import association, binned
from priorform.operators.cleaning import plain_double
from priorform.operators.ordering import ranked
from priorform.operators.report import CAT, CONT, Analysis
from priorform.sources.sinks import stage

TILE = 64  # columns; the sums of two tiles take about ten megabytes
ROWS = 8192  # of a block
PAIR_SUMS = "x string, y string, a int, b int, n double, ny double, s double, sx double, sy double, qx double, qy double, pxy double"
LEVEL_SUMS = "cat string, level string, cont string, bin int, n double, ny double, s double, q double"


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(numbers with NaN for missing, response with NaN for missing, batch) of at most ``ROWS`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            flat = part.column(part.schema.get_field_index("values")).flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, width)
            y = part.column(part.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(np.float64)
            yield values, y, part


def _one_hot(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Zeros and ones, ``BINS`` columns per number; a missing number has no one."""
    out = np.zeros((len(values), len(edges), binned.BINS), np.float32)
    for i, e in enumerate(edges):
        has = np.flatnonzero(~np.isnan(values[:, i]))
        if len(e):
            out[has, i, np.clip(np.searchsorted(e, values[has, i], "right") - 1, 0, binned.BINS - 1)] = 1
    return out.reshape(len(values), -1)


def _complete(df: DataFrame):
    """Whether a row has a value in every column of the frame."""
    tests = [
        F.col(f"`{f.name}`").isNotNull() & (~F.isnan(F.col(f"`{f.name}`")) if isinstance(f.dataType, (DoubleType, FloatType)) else F.lit(True))
        for f in df.schema
    ]
    return reduce(lambda a, b: a & b, tests)


def pair_sums(a: Analysis) -> DataFrame:
    """``PAIR_SUMS`` of all pairs of numbers, stored: one row per cell, and one with ``a`` and ``b`` NULL per pair.

    Cells are those with both bins known; n, ny and s are rows, known responses and their sum. The row of a pair has the
    sums over rows complete in all columns of the frame, of values less the column's mean.
    """
    conts, bins = list(a.conts), binned.BINS
    edges = [np.array(a.edges[c], np.float64) for c in conts]
    center = np.array([a.center[c] for c in conts])
    tiles = [range(i, min(i + TILE, len(conts))) for i in range(0, len(conts), TILE)]
    y = a.y if a.y is not None else F.lit(None).cast("double")
    rows = a.df.select(F.array(*[plain_double(a.df, c) for c in conts]).alias("values"), y.alias("y"), _complete(a.df).alias("complete"))

    def tile_sums(left: range, right: range):
        used = sorted({*left, *right})
        at = {c: i for i, c in enumerate(used)}
        pairs = [(i, j) for i in left for j in right if i < j]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = len(used) * bins
            n, ny, s = (np.zeros((m, m)) for _ in range(3))
            whole, total, products = 0, np.zeros(len(used)), np.zeros((len(used), len(used)))
            for values, response, part in _blocks(batches, len(conts)):
                hot = _one_hot(values[:, used], [edges[i] for i in used])
                known = ~np.isnan(response)
                counts = hot.T @ hot  # exact in single precision: at most ROWS
                n += counts
                ny += counts if known.all() else hot[known].T @ hot[known]
                s += hot[known].T.astype(np.float64) @ (hot[known] * response[known][:, None])
                complete = part.column(part.schema.get_field_index("complete")).to_numpy(zero_copy_only=False).astype(bool)
                centred = values[complete][:, used] - center[used]
                whole, total, products = whole + len(centred), total + centred.sum(0), products + centred.T @ centred
            out = {c: [] for c in (f.split()[0] for f in PAIR_SUMS.split(", "))}
            for i, j in pairs:
                u, v = at[i], at[j]
                block = (slice(u * bins, (u + 1) * bins), slice(v * bins, (v + 1) * bins))
                p, q = np.nonzero(n[block])
                none = np.full(len(p) + 1, None)
                for c, cells, pair in (("n", n[block][p, q], whole), ("ny", ny[block][p, q], None), ("s", s[block][p, q], None), ("a", p + 1, None), ("b", q + 1, None)):
                    out[c] += [*cells.tolist(), pair]
                for c, pair in (("sx", total[u]), ("sy", total[v]), ("qx", products[u, u]), ("qy", products[v, v]), ("pxy", products[u, v])):
                    out[c] += [*none[1:], float(pair)]
                out["x"] += [conts[i]] * len(none)
                out["y"] += [conts[j]] * len(none)
            if out["x"]:
                kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
                yield pa.RecordBatch.from_arrays([pa.array(out[f.split()[0]], kinds[f.split()[1]]) for f in PAIR_SUMS.split(", ")], names=list(out))

        return rows.mapInArrow(run, PAIR_SUMS)

    passes = [tile_sums(tiles[i], tiles[j]) for i in range(len(tiles)) for j in range(i, len(tiles))]
    every = reduce(DataFrame.unionByName, passes)
    sums = [F.sum(c).alias(c) for c in ("n", "ny", "s", "sx", "sy", "qx", "qy", "pxy")]
    return stage(every.groupBy("x", "y", "a", "b").agg(*sums))


def level_sums(a: Analysis) -> DataFrame:
    """``LEVEL_SUMS`` of all categories with all numbers, stored: per level and bin, and with ``bin`` NULL per level.

    Missing levels and numbers are in no cell. The row of a level has n, sum ``s`` and sum of squares ``q`` of the values
    less the column's mean. Levels of a block are summed together, so that any number of levels fits.
    """
    cats, conts, bins = list(a.cats), list(a.conts), binned.BINS
    edges = [np.array(a.edges[c], np.float64) for c in conts]
    center = np.array([a.center[c] for c in conts])
    y = a.y if a.y is not None else F.lit(None).cast("double")
    rows = a.df.select(F.array(*[plain_double(a.df, c) for c in conts]).alias("values"), y.alias("y"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cats)])
    names, numbers = pa.array(conts), np.repeat(np.arange(len(conts)), bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, response, part in _blocks(batches, len(conts)):
            hot = _one_hot(values, edges).astype(np.float64)
            known = ~np.isnan(response)
            filled = np.where(known, response, 0.0)[:, None]
            has = ~np.isnan(values)
            centred = np.where(has, values - center, 0.0)
            for k, cat in enumerate(cats):
                coded = part.column(part.schema.get_field_index(f"c{k}")).dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                there = np.flatnonzero(~np.isnan(code.astype(np.float64)))
                if not len(there):
                    continue
                order = there[np.argsort(code[there], kind="stable")]
                code = code[order].astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                summed = lambda m: np.add.reduceat(m[order], first, axis=0)
                n, ny, s = summed(hot), summed(hot * known[:, None]), summed(hot * filled)
                level = coded.dictionary.take(pa.array(code[first]))
                at, cell = np.nonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cat] * len(at)), level.take(pa.array(at)), names.take(pa.array(numbers[cell])), pa.array((cell % bins + 1).astype(np.int32)),
                     pa.array(n[at, cell]), pa.array(ny[at, cell]), pa.array(s[at, cell]), pa.array([None] * len(at), pa.float64())],
                    names=["cat", "level", "cont", "bin", "n", "ny", "s", "q"],
                )
                n, s, q = summed(has.astype(np.float64)), summed(centred), summed(centred * centred)
                at, cell = np.nonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cat] * len(at)), level.take(pa.array(at)), names.take(pa.array(cell)), pa.array([None] * len(at), pa.int32()),
                     pa.array(n[at, cell]), pa.array([None] * len(at), pa.float64()), pa.array(s[at, cell]), pa.array(q[at, cell])],
                    names=["cat", "level", "cont", "bin", "n", "ny", "s", "q"],
                )

    sums = [F.sum(c).alias(c) for c in ("n", "ny", "s", "q")]
    return stage(rows.mapInArrow(run, LEVEL_SUMS).groupBy("cat", "level", "cont", "bin").agg(*sums))


def _scored(a: Analysis, cells: DataFrame) -> DataFrame:
    """(x, y, dmr, wdmr) from cells (x, y, a, b, n, ny, s)."""
    total, mean = a.population
    table = binned.cell_table(
        cells.select(F.struct("x", "y").alias("pair"), "a", "b", "n", F.col("ny").alias("n_response"), F.col("s").alias("sum_response")), total, mean
    )
    return table.groupBy("pair").agg(F.avg("dmr").alias("dmr"), F.avg("wdmr").alias("wdmr")).select("pair.x", "pair.y", "dmr", "wdmr")


def _table(corr: DataFrame, dmr: DataFrame, types: tuple[str, str], by: str) -> DataFrame:
    """Correlations of pairs beside their DMR, as in the tables of :mod:`report`; two frames of one row per pair."""
    extra = [c for c in corr.columns if c not in ("x", "y", "corr")]
    out = corr.join(dmr, on=["x", "y"], how="left").select(
        F.col("x").alias("predictor_1"), F.col("y").alias("predictor_2"), F.lit(types[0]).alias("type_1"), F.lit(types[1]).alias("type_2"),
        "corr", F.abs("corr").alias("abs_corr"), *extra, "dmr", "wdmr",
    )
    return ranked(out, by, "predictor_1", "predictor_2")


def cont_cont_table(a: Analysis, *, rank_by: str = "wdmr", p_values: bool = True) -> DataFrame:
    """Pearson with slope test and two-dimensional DMR of every pair of numbers; a table without rows gives no pairs."""
    sums = pair_sums(a)
    corr = association.pearson_from_sums(sums.where("a is null")).select("x", "y", "corr", "t", "n")
    if p_values:
        corr = association.with_p_values(corr)
    return _table(corr.drop("n"), _scored(a, sums.where("a is not null")), (CONT, CONT), rank_by)


def cat_cont_table(a: Analysis, *, rank_by: str = "wdmr") -> DataFrame:
    """Correlation ratio and two-dimensional DMR of every category with every number."""
    sums = level_sums(a)
    groups = sums.where("bin is null").select("cat", "level", "cont", "n", "s", "q", F.lit(0).alias("x"))
    corr = association.ratios_from_groups(groups).select(F.col("cat").alias("x"), F.col("cont").alias("y"), "corr")
    cells = sums.where("bin is not null").select(F.col("cat").alias("x"), F.col("cont").alias("y"), F.col("level").alias("a"), F.col("bin").alias("b"), "n", "ny", "s")
    return _table(corr, _scored(a, cells), (CAT, CONT), rank_by)
