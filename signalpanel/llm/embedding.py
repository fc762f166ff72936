"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one vector kept of each group.

1. Equal vectors of one label are one node with a multiplicity (grouped with partial
   sums, so a vector that a third of all rows share is one row).
2. Spherical k-means on a bounded sample, chosen by hash, gives cells for each vector length. Every node is
   indexed in the cell of its nearest centre.
3. For unit vectors at cosine t or more, |x - y| <= sqrt(2 - 2t). If x lives in cell a
   and y in cell b, (x - y).(a - b) is the sum of both nodes' shortfalls, so at least
   one of the two falls short of the other's cell by no more than half of
   sqrt(2 - 2t) |a - b|. Each node queries all cells within that reach: no pair is
   missed. A `margin` below it trades that guarantee for fewer cells.
4. Cells are split into blocks of at most `block` indexed nodes, queries go to every
   block of a cell, and a block compares by matrix products in double precision. It
   returns for each node a number of links and one edge, never pairs.
5. Components of these edges; the smallest id of each component is kept.

Rows with a null label, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; vectors of different length never link. A null
vec_id is never the smallest one while another is, and is not kept. Repeated rows link
with each other. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors(column, dim: int) -> np.ndarray:
    return unit(np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(-1, dim))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centres; an empty cell takes the vector that fits its own centre worst."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        sims = x @ centres.T
        home = sims.argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, home, x)
        norm = np.sqrt((total * total).sum(1))
        bad = norm < 1e-12
        total[bad] = x[np.argsort(sims.max(1))[: int(bad.sum())]]
        centres = total / np.sqrt((total * total).sum(1, keepdims=True))
    return centres


class Cells:
    """Centres for one vector length, and which cells a vector must query."""

    def __init__(self, centres: np.ndarray, threshold: float, margin: float | None):
        self.centres = centres
        apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
        exact = np.sqrt(2 - 2 * threshold) * apart / 2 + 1e-9
        self.reach = exact if margin is None else np.minimum(exact, margin)

    def probe(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home cell of each vector, and a boolean matrix of the cells that it queries."""
        sims = x @ self.centres.T
        home = sims.argmax(1)
        return home, sims[np.arange(len(x)), home][:, None] - sims <= self.reach[home]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in each one's component, by hooking and shortcutting."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root[root] != root).any():
            root = root[root]


def compare(cells: Cells, threshold: float, query: dict, index: dict, step: int = 512):
    """Links between queries and indexed nodes of one block: (keys, link counts, root keys) of the nodes that have any."""
    keys = np.unique(np.concatenate([query["key"], index["key"]]))
    qat, iat = np.searchsorted(keys, query["key"]), np.searchsorted(keys, index["key"])
    links, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
    i_home, i_probe = cells.probe(index["x"])
    q_home, _ = cells.probe(query["x"])
    for lo in range(0, len(qat), step):
        at = slice(lo, lo + step)
        near = query["x"][at] @ index["x"].T >= threshold
        near &= query["key"][at][:, None] != index["key"][None]
        a, b = np.nonzero(near)
        if not len(a):
            continue
        q, i = qat[at][a], iat[b]
        np.add.at(links, q, index["n"][b])
        # where the indexed node doesn't query the other's cell, this is the only meeting: it counts for both
        alone = ~i_probe[b, q_home[at][a]]
        np.add.at(links, i[alone], query["n"][at][a[alone]])
        root = _roots(len(keys), np.concatenate([np.arange(len(keys)), q]), np.concatenate([root, i]))
    met = links > 0
    # an indexed node that its partner will meet elsewhere still hangs on the edge found here
    met |= root != np.arange(len(keys))
    return keys[met], links[met], keys[root[met]]


def near_duplicates(df: DataFrame, threshold: float = 0.93, cells: int | None = None, margin: float | None = None, sample: int = 20_000, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    # single precision, where the table has it, until the products: half the bytes of a shuffle
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("x"))
    finite = F.size("x") > 0
    finite &= ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0)
    rows = rows.withColumn("key", F.when(F.col("label").isNotNull() & F.col("x").isNotNull() & finite, F.xxhash64("label", "x")))
    rows = saved(rows)
    valid = rows.where("key IS NOT NULL")
    nodes = saved(valid.groupBy("key", "label", "x").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")))
    found = saved(_links(nodes, threshold, cells, margin, sample, block))
    pairs, links = found.select(F.col("key").alias("a"), F.col("root").alias("b")), found.groupBy("key").agg(F.sum("links").alias("links"))
    found = components(pairs).withColumnRenamed("node", "key")
    own = nodes.select("key", "n", "least").join(links, "key", "left").join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    own = own.join(least, "component").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    out = rows.select("vec_id", "key").join(own, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _grids(nodes: DataFrame, threshold: float, cells: int | None, margin: float | None, sample: int) -> dict[int, Cells]:
    """Cells of each vector length that a bounded sample holds; other lengths are rare and have one cell each."""
    n, longest = nodes.agg(F.count("*"), F.max("dim")).first()
    seen = nodes.select("key", "dim", "x").orderBy(F.xxhash64("key"), "key").limit(max(1, min(sample, (64 << 20) // (8 * (longest or 1))))).toPandas()
    grids = {}
    for dim, x in seen.groupby("dim").x:
        x = unit(np.stack(x.to_numpy()).astype(np.float64))
        share = n * len(x) / len(seen)
        grids[int(dim)] = Cells(spherical_kmeans(x, min(cells or max(1, int(share**0.5 / 4)), max(1, len(x) // 8) if cells is None else len(x))), threshold, margin)
    return grids


def _links(nodes: DataFrame, threshold: float, cells: int | None, margin: float | None, sample: int, block: int) -> DataFrame:
    """key, links, root of the nodes that meet another; a key may come from several blocks."""
    nodes = nodes.withColumn("dim", F.size("x"))
    grids = _grids(nodes, threshold, cells, margin, sample)

    def dealt_cells(batches, column: int):
        """For parts of a batch whose vectors have one length: its rows, their home cells, and the cells that they query."""
        for big in batches:
            length = np.diff(big.column(column).offsets.to_numpy())
            for dim in np.unique(length):
                rows = np.flatnonzero(length == dim)
                for lo in range(0, len(rows), 4096):
                    part = big.take(pa.array(rows[lo : lo + 4096]))
                    if int(dim) in grids:
                        yield part, *grids[int(dim)].probe(vectors(part.column(column), int(dim)))
                    else:
                        yield part, np.zeros(len(part), np.int64), np.ones((len(part), 1), bool)

    def deal(batches):
        """A row for each cell that a node queries; home says whether it is indexed there."""
        for part, home, probe in dealt_cells(batches, 4):
            at, cell = np.nonzero(probe)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(at)) for i in range(5)), pa.array(cell.astype(np.int32)), pa.array(home[at] == cell)], ["key", "label", "n", "dim", "x", "cell", "home"])

    def deal_home(batches):
        for part, home, _ in dealt_cells(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(home.astype(np.int32))], ["label", "dim", "cell"])

    sizes = nodes.select("label", "dim", "x").mapInArrow(deal_home, "label string, dim int, cell int").groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = nodes.select("key", "label", "n", "dim", "x").mapInArrow(deal, f"key long, label string, n long, dim int, x {dict(nodes.dtypes)['x']}, cell int, home boolean")
    # cells without indexed nodes are queried in vain: the inner join drops those rows
    dealt = dealt.join(sizes, ["label", "dim", "cell"])
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("indexed", F.col("home") & (F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")) == F.col("block")))

    def block_links(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
        x, own = vectors(t.column("x"), dim), t.column("indexed").to_numpy().astype(bool)
        every = {"key": key, "n": n, "x": x}
        grid = grids.get(dim) or Cells(x[:1], threshold, margin)  # one cell, which all query
        k, links, root = compare(grid, threshold, every, {name: v[own] for name, v in every.items()})
        return pa.table({"key": pa.array(k, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    return dealt.select("label", "dim", "cell", "block", "key", "n", "x", "indexed").groupBy("label", "dim", "cell", "block").applyInArrow(block_links, "key long, links long, root long")
