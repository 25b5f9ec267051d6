"""Embedding near-duplicates by randomised-rotation binary codes.

Every vector is normalised and rotated by a seeded random orthogonal matrix;
its code is the sign of each coordinate. Stored with it is the correction
factor <code / sqrt(D), vector>: dividing the inner product of the code with a
rotated query by it gives an unbiased estimate of their cosine, with a standard
error of sqrt((1 - f^2) / (f^2 (D - 1))). Pairs whose estimate plus ERRORS
standard errors stays below the threshold are dropped; all others are computed
again in double precision from the vectors themselves, which alone decides.

Pairs to estimate: equal vectors are one representative. The vectors of a label
are dealt to cells by their nearest pivot (pivots are a bounded sample, one per
CELL_ROWS vectors, MAX_PIVOTS in all; every vector is indexed). A vector is
compared with every cell that can hold a neighbour, whatever its direction: a
neighbour t x + sqrt(1 - t^2) u of x, u orthogonal to x, is no nearer to pivot
p' than to x's own p if x (p - p') > sqrt(1 - t^2) |p - p'|. Cells are compared
block by block (BLOCK rows of either side), so a cell that holds a third of all
vectors is many tasks; in the blocks the codes prune. Nothing is missed but by
the code's error bound. Blocks return link counts and a spanning forest of their
links, never the pairs.

Defined cases: a null label, a null, empty or zero vector, and null or
non-finite components link with nothing; vectors of different lengths are never
compared; equal vectors (same label) are linked; vec_id null is ignored as a
component's name unless there is no other; rows with equal vec_id count as
separate vectors; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfs.llm.common import BROADCAST_ROWS, bounded_broadcast, connected_components, hot_join, materialize, prepare

THRESHOLD = 0.93
ERRORS = 5.0
#: Allowance for rounding where cells are ruled out.
ROUNDING = 1e-9
CELL_ROWS = 4096
MAX_PIVOTS = 8192
BLOCK = 2048
SEED = 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs, correction factors, rotated) of unit vectors ``x``."""
    y = x @ turn
    signs = np.where(y >= 0, 1.0, -1.0)
    return signs, np.abs(y).sum(axis=1) / math.sqrt(x.shape[1]), y


def estimate(signs: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines [codes, queries] and each code's standard error."""
    d = signs.shape[1]
    est = (signs @ rotated.T) / (math.sqrt(d) * factor[:, None])
    return est, np.sqrt(np.maximum(0.0, 1 - factor ** 2) / (factor ** 2 * max(1, d - 1)))


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first: squares of extreme components neither vanish nor overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(links: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the bipartite ``links``, searched row by row."""
    out, open_rows, open_cols = [], np.ones(len(rows), dtype=bool), np.ones(len(cols), dtype=bool)
    for first in range(len(rows)):
        if not open_rows[first]:
            continue
        open_rows[first] = False
        queue = [(True, first)]
        while queue:
            is_row, k = queue.pop()
            if is_row:
                new = np.flatnonzero(links[k] & open_cols)
                open_cols[new] = False
                out += [(rows[k], c) for c in cols[new].tolist()]
                queue += [(False, c) for c in new.tolist()]
            else:
                new = np.flatnonzero(links[:, k] & open_rows)
                open_rows[new] = False
                out += [(r, cols[k]) for r in rows[new].tolist()]
                queue += [(True, r) for r in new.tolist()]
    return out


def _block_links(threshold: float, turn_seed: int):
    """Of one block (queries and base rows): link counts per query, forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, ask = pdf[pdf["base"]], pdf[~pdf["base"]]
        cols = ["kind", "a", "b"]
        if not len(base) or not len(ask):
            return pd.DataFrame(columns=cols).astype("int64")
        xb, xq = unit(np.stack(base["v"].to_numpy()).astype(np.float64)), unit(np.stack(ask["v"].to_numpy()).astype(np.float64))
        turn = rotation(xb.shape[1], turn_seed)
        signs, factor, _ = encode(xb, turn)
        est, error = estimate(signs, factor, xq @ turn)
        maybe_b, maybe_q = np.nonzero(est + ERRORS * error[:, None] >= threshold)
        links = np.zeros((len(ask), len(base)), dtype=bool)
        for k in range(0, len(maybe_b), 1 << 18):
            i, j = maybe_b[k:k + (1 << 18)], maybe_q[k:k + (1 << 18)]
            links[j, i] = np.einsum("ij,ij->i", xb[i], xq[j]) >= threshold
        ib, iq = base["rep"].to_numpy(), ask["rep"].to_numpy()
        links &= iq[:, None] != ib[None, :]
        # weights: the copies that each representative stands for
        n = links @ base["n"].to_numpy()
        some = np.flatnonzero(n)
        edges = forest(links[some], iq[some], ib)
        return pd.DataFrame([(0, int(iq[k]), int(n[k])) for k in some] + [(1, int(a), int(b)) for a, b in edges],
                            columns=cols).astype("int64")

    return run


def _cells(pivots: dict, threshold: float):
    """Partition function: each representative's home cell and the cells it
    must be compared with."""
    # below 0 a neighbour may be anywhere
    away = math.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else float("inf")

    def run(batches):
        for pdf in batches:
            out = []
            for (label, dim), part in pdf.groupby(["label", "dim"], sort=False):
                x = unit(np.stack(part["v"].to_numpy()).astype(np.float64))
                p = pivots.get((label, dim))
                if p is None or len(p) == 1:
                    home, reach = np.zeros(len(x), dtype=np.int64), np.ones((len(x), 1), dtype=bool)
                else:
                    near = x @ p.T
                    home = near.argmax(axis=1)
                    gap = near.max(axis=1, keepdims=True) - near
                    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (p @ p.T)))[home]
                    # the home cell is always within reach (infinity times no distance is not a number)
                    reach = ~(gap > away * apart + ROUNDING)
                q, cell = np.nonzero(reach)
                rep, v, n = part["rep"].to_numpy(), part["v"].to_numpy(), part["n"].to_numpy()
                out.append(pd.DataFrame({"label": label, "dim": dim, "cell": home, "base": True, "rep": rep, "v": v, "n": n}))
                out.append(pd.DataFrame({"label": label, "dim": dim, "cell": cell, "base": False, "rep": rep[q], "v": v[q], "n": n[q]}))
            if out:
                yield pd.concat(out)

    return run


def choose_pivots(reps: DataFrame) -> dict:
    """{(label, dim): unit vectors}: per label one pivot for CELL_ROWS
    representatives, MAX_PIVOTS in all at most; labels of one cell are left out."""
    sizes = (reps.groupBy("label", "dim").agg(F.count("*").alias("rows")).filter(F.col("rows") > CELL_ROWS)
             .orderBy(F.desc("rows"), "label", "dim").limit(MAX_PIVOTS // 2))
    sizes = sizes.collect()  # MAX_PIVOTS / 2 rows at most
    want = {(r.label, r.dim): -(-r.rows // CELL_ROWS) for r in sizes}
    scale = min(1.0, MAX_PIVOTS / max(1, sum(want.values())))
    rows = {(r.label, r.dim): r.rows for r in sizes}
    want = {k: max(2, int(n * scale)) for k, n in want.items()}
    if not want:
        return {}
    spark = reps.sparkSession
    table = spark.createDataFrame([(l, d, n, min(1.0, 4.0 * n / rows[l, d] + 20.0 / rows[l, d])) for (l, d), n in want.items()],
                                  "label long, dim int, want int, part double")
    near = reps.join(F.broadcast(table), ["label", "dim"]).withColumn("h", F.xxhash64(F.lit(SEED), "rep"))
    some = near.filter((F.col("h") / F.lit(2.0 ** 64) + 0.5) < F.col("part"))
    first = Window.partitionBy("label", "dim").orderBy("h", "rep")
    got = some.withColumn("k", F.row_number().over(first)).filter("k <= want").select("label", "dim", "v").toPandas()
    return {k: unit(np.stack(g["v"].to_numpy()).astype(np.float64)) for k, g in got.groupby(["label", "dim"])}


def embedding_dedup(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id,
    n_links (others linked directly), component_id (smallest vec_id reachable),
    kept (vec_id = component_id)."""
    prepare(spark)
    good = (F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & F.coalesce(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)), F.lit(False))
            & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False)))
    rows = vectors.select(F.monotonically_increasing_id().alias("seq"), F.col("vec_id").cast("long"),
                          F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    rows = materialize(spark, rows.withColumn("good", F.coalesce(good, F.lit(False))), "emb_rows")
    reps = (rows.filter("good").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("seq").alias("rep"), F.min("vec_id").alias("least"))
            .withColumn("dim", F.size("v")))
    reps = materialize(spark, reps, "emb_reps")
    placed = reps.select("label", "dim", "rep", "v", "n").mapInPandas(
        _cells(choose_pivots(reps), threshold),
        "label long, dim int, cell int, base boolean, rep long, v array<double>, n long")
    placed = materialize(spark, placed, "emb_cells")
    # Two-way blocks: each query block of a cell meets each base block.
    size = placed.groupBy("label", "dim", "cell").agg(
        F.sum(F.col("base").cast("long")).alias("nb"), F.sum((~F.col("base")).cast("long")).alias("nq"))
    size = size.filter("nb > 0 and nq > 0").select(
        F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("cell").alias("_c"),
        F.ceil(F.col("nb") / BLOCK).cast("int").alias("kb"), F.ceil(F.col("nq") / BLOCK).cast("int").alias("kq"))
    size, _ = bounded_broadcast(materialize(spark, size, "emb_sizes"), BROADCAST_ROWS)
    blocked = placed.join(size, F.expr("label = _l and dim = _d and cell = _c"))
    own = F.expr("cast(pmod(xxhash64(rep), case when base then kb else kq end) as int)")
    blocked = blocked.withColumn("own", own).withColumn(
        "other", F.explode(F.expr("sequence(0, case when base then kq else kb end - 1)")))
    blocked = blocked.withColumn("bb", F.expr("case when base then own else other end")).withColumn(
        "bq", F.expr("case when base then other else own end"))
    found = blocked.groupBy("label", "dim", "cell", "bb", "bq").applyInPandas(
        lambda pdf: _block_links(threshold, SEED)(pdf), "kind long, a long, b long")
    found = materialize(spark, found, "emb_links")
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("far"))
    comp = connected_components(spark, found.filter("kind = 1").select("a", "b"))
    classed = materialize(
        spark, reps.select("label", "v", "rep", "n", "least").join(counts, "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", "n", "least", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("comp"), F.xxhash64("label", "v").alias("key"), "label", "v"), "emb_classes")
    heads = classed.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("n_reps"))
    named = hot_join(classed, heads, "comp", "n_reps", "rep").select("key", "label", "v", "n", "n_links", "component_id")
    # Rows to their representative by the vector itself; the key only deals out.
    keys = materialize(spark, named.groupBy("key").agg(F.sum("n").alias("rows"), F.collect_list(
        F.struct("label", "v", "n_links", "component_id")).alias("found")), "emb_named")
    linked = (hot_join(rows.filter("good").withColumn("key", F.xxhash64("label", "v")), keys, "key", "rows", "seq")
              .withColumn("m", F.expr("filter(found, f -> f.label = label and f.v = v)[0]"))
              .select("vec_id", F.col("m.n_links").cast("long").alias("n_links"), F.col("m.component_id").alias("component_id")))
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
