"""Near-duplicate vectors within cells of spherical k-means.

Cells are fitted for each label on a bounded sample.  Each distinct vector is at home
in the cell of its nearest centre; it visits as a guest every cell of its label that may
hold a partner: the dividing hyperplane must be near enough, and so must the cell's
widest vector.  So no link is lost.  Cosines are computed in blocks in double precision;
copies are one vector with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import table

#: Distinct vectors that a fit reads, that a cell aims at, and fewest of the sample that a cell is fitted on.
SAMPLE, CELL, FEWEST = 8_192, 2_048, 4
#: Homes and partners of one comparing task.
BLOCK = 2_048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centres of ``k`` cells of unit vectors; an emptied cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        some = norm > 0
        centres[some] = sums[some] / norm[some, None]
    return centres


def _unit(lists: pa.Array) -> np.ndarray:
    """Vectors of one length, each at length one."""
    flat = np.asarray(lists.flatten()).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, least: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """(key, n_links, component_id, kept) of each row.

    Rows link when their labels are equal and not null and the cosine of their
    vectors is ``least`` or more.  Null, empty, zero and non-finite vectors, vectors
    of other lengths than their partner's and rows with a null label link with
    nothing.  Copies link with each other; a repeated row is one more copy.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("v", F.when(F.col("sound"), F.transform("v", lambda x: x + F.lit(0.0))))
    marked = table(rows.withColumn("print", F.when(F.col("sound"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")).cast("binary"), 256))), "vectors")
    distinct = table(marked.where("sound").groupBy("print").agg(F.count("*").alias("copies"), F.min("key").alias("low"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = _links(distinct.withColumn("dim", F.size("v")), least)
    found = table(found, "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.select("node", F.explode("tree").alias("b")).select(F.col("node").alias("a"), "b")
    roots = table(components(edges), "roots")
    lows = roots.join(distinct.select("node", "low"), "node")
    named = lows.join(lows.groupBy("root").agg(F.min("low").alias("component")), "root").select("node", "component")
    of_print = distinct.select("print", "node", "copies", "low").join(counts, "node", "left").join(named, "node", "left").select("print", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component"))
    # written, so that Spark can split the join where many rows are copies of one vector
    out = marked.select("key", "print").join(table(of_print, "components"), "print", "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))


def _alone(column: pa.Array) -> Iterator[np.ndarray]:
    """Places of equal values, each in turn."""
    codes = column.dictionary_encode().indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ()


def _fit(distinct: DataFrame) -> dict[tuple, np.ndarray]:
    """Centres of each (label, length) that has enough vectors for two cells, from a sample of all."""
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sample = distinct.select("print", "label", "dim", "v").orderBy("print").limit(SAMPLE).join(sizes, ["label", "dim"]).orderBy("print").toArrow().combine_chunks()
    centres = {}
    for own in _alone(pa.array([f"{a} {b}" for a, b in zip(sample.column("dim").to_pylist(), sample.column("label").to_pylist())], pa.string())):
        part = sample.take(pa.array(own))
        k = min(part.column("n")[0].as_py() // CELL, len(own) // FEWEST)
        if k > 1:
            centres[part.column("label")[0].as_py(), part.column("dim")[0].as_py()] = spherical_kmeans(_unit(part.column("v").combine_chunks()), k)
    return centres


def _links(distinct: DataFrame, least: float) -> DataFrame:
    """(node, n, tree): linked rows of other vectors, and links enough to connect each component."""
    kind = distinct.schema["label"].dataType.simpleString()
    centres = distinct.sparkSession.sparkContext.broadcast(_fit(distinct))
    reach, angle = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9, float(np.arccos(least)) + 1e-9

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None, tuple]]:
        """Vectors of one label and length, their cosines with its centres (None where it has one cell), and both."""
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                for own in _alone(pa.array([f"{a} {b}" for a, b in zip(batch.column("dim").to_pylist(), batch.column("label").to_pylist())], pa.string())):
                    part = batch.take(pa.array(own))
                    group = part.column("label")[0].as_py(), part.column("dim")[0].as_py()
                    c = centres.value.get(group)
                    yield part, None if c is None else _unit(part.column("v")) @ c.T, group

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, near, _ in parts(batches):
            if near is not None:
                home = near.argmax(1)
                cells = np.unique(home)
                low = [near[home == c, c].min() for c in cells]
                yield pa.record_batch([part.column("label").slice(0, 1).take(pa.array(np.zeros(len(cells), np.int64))), part.column("dim").slice(0, 1).take(pa.array(np.zeros(len(cells), np.int64))), pa.array(cells.astype(np.int32)), pa.array(low, pa.float64())], names=["label", "dim", "cell", "low"])

    # no more rows than centres, and these no more than the sample
    lows = distinct.select("label", "dim", "v").mapInArrow(widest, f"label {kind}, dim int, cell int, low double").groupBy("label", "dim", "cell").agg(F.min("low").alias("low")).collect()
    radius = {g: np.full(len(c), -np.inf) for g, c in centres.value.items()}
    for r in lows:
        radius[r.label, r.dim][r.cell] = np.arccos(min(1.0, r.low))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, near, group in parts(batches):
            row, cell, is_home = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), np.ones(part.num_rows, dtype=bool)
            if near is not None:
                c, home = centres.value[group], near.argmax(1)
                gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-12))
                # a partner at home in cell j is on j's side of the hyperplane between the two centres, and no farther from j's than its widest
                beyond = (near[row, home][:, None] - near) / gap[home]
                visits = (beyond <= reach) & (np.arccos(np.clip(near, -1, 1)) <= radius[group] + angle)
                visits[row, home] = True
                row, cell = np.nonzero(visits)
                is_home = home[row] == cell
            yield pa.record_batch([pa.array(cell.astype(np.int32)), *(part.column(n).take(pa.array(row)) for n in ("label", "dim", "node", "copies")), pa.array(is_home), part.column("v").take(pa.array(row))], names=["cell", "label", "dim", "node", "copies", "home", "v"])

    by = ["cell", "label", "dim"]
    dealt = table(distinct.select("label", "dim", "node", "copies", "v").mapInArrow(deal, f"cell int, label {kind}, dim int, node bigint, copies bigint, home boolean, v array<double>"), "dealt")
    # a large cell is cut into blocks of homes by blocks of all: memory of a task stays bounded
    sizes = dealt.groupBy(by).agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("hs"), F.ceil(F.count("*") / BLOCK).cast("int").alias("gs")).where("hs > 0")
    joined = dealt.join(sizes, by)
    salt = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
    as_home = joined.where("home").select(*by, (salt % F.col("hs")).alias("h"), F.explode(F.sequence(F.lit(0), F.col("gs") - 1)).alias("g"), "node", "copies", F.lit(True).alias("home"), "v")
    as_any = joined.select(*by, F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("h"), (salt % F.col("gs")).alias("g"), "node", "copies", F.lit(False).alias("home"), "v")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        home = group.column("home").to_numpy()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        x = _unit(group.column("v").combine_chunks())
        h, g = np.flatnonzero(home), np.flatnonzero(~home)
        linked = np.zeros((len(h), len(g)), dtype=bool)
        for a in range(0, len(h), 256):
            linked[a : a + 256] = x[h[a : a + 256]] @ x[g].T >= least
        linked &= node[h][:, None] != node[g][None, :]
        some = np.flatnonzero(linked.any(1))
        one, other = _thin(linked)
        order = np.argsort(one, kind="stable")
        cut = np.searchsorted(one[order], np.append(some, len(h)))
        tree = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(node[g][other[order]]))
        return pa.table({"node": node[h[some]], "n": linked[some] @ copies[g], "tree": tree})

    return as_home.unionByName(as_any).groupBy(*by, "h", "g").applyInArrow(compare, "node bigint, n bigint, tree array<bigint>")


def _thin(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of links enough to connect all that the links of a matrix connect: rows and columns in turn, from a row without a place."""
    left_rows, left_columns = linked.any(1), linked.any(0)
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in np.flatnonzero(left_rows).tolist():
        if not left_rows[start]:
            continue
        front = np.array([start])
        left_rows[start] = False
        while len(front):
            some = np.flatnonzero(linked[front].any(0) & left_columns)
            rows.append(front[linked[np.ix_(front, some)].argmax(0)] if len(some) else some)
            columns.append(some)
            left_columns[some] = False
            front = np.flatnonzero(linked[:, some].any(1) & left_rows) if len(some) else some
            rows.append(front)
            columns.append(some[linked[np.ix_(front, some)].argmax(1)] if len(front) else front)
            left_rows[front] = False
    return np.concatenate(rows), np.concatenate(columns)
