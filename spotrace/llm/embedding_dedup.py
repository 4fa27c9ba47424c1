"""Near-duplicate embeddings by tiled comparison in principal-component order.

Vectors are turned to the axes of their second moments, the strongest first.  For two tiles the
leading axes are multiplied first; what the others can add is bounded by the product of the suffix
norms, and a pair is given up once that cannot reach the threshold.  Tiles follow the first
axis, so whole pairs of tiles that lie too far apart on it are never formed.  Tiles have a bounded
number of rows, whatever the values; copies of one vector fill many tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import graph
from spotrace.session import materialize

THRESHOLD = 0.95
TILE = 8192
BLOCK = 1024
STEPS = (12, 24, 40)
SLACK = 1e-9


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v) of the rows that can link: an id, and a vector of finite components that is not zero."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes(rows: DataFrame, size: int) -> np.ndarray:
    """Principal axes of unit vectors of one size, strongest first; the driver holds a size-by-size matrix."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                x = _unit(_stack(batch["v"]))
                total += x.T @ x
        yield pd.DataFrame({"k": np.arange(size * size), "s": total.reshape(-1)})

    sums = rows.select("v").mapInPandas(add, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(size * size)
    for r in sums:
        flat[r["k"]] = r["s"]
    return np.linalg.eigh(flat.reshape(size, size))[1][:, ::-1]


def _hits(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Pairs whose product reaches the threshold: a dense mask, or two lists of places."""
    size = a.shape[1]
    steps = [k for k in STEPS if k < size] + [size]
    rest = [(np.linalg.norm(a[:, k:], axis=1), np.linalg.norm(b[:, k:], axis=1)) for k in steps]
    lead = a[:, :steps[0]] @ b[:, :steps[0]].T
    open_ = lead + np.multiply.outer(*rest[0]) >= threshold - SLACK
    if np.count_nonzero(open_) > 0.1 * open_.size:
        return a @ b.T >= threshold - SLACK
    i, j = np.nonzero(open_)
    total = lead[i, j]
    for done, upto, (ra, rb) in zip(steps, steps[1:], rest[1:]):
        total = total + np.einsum("ij,ij->i", a[i, done:upto], b[j, done:upto])
        keep = total + ra[i] * rb[j] >= threshold - SLACK
        i, j, total = i[keep], j[keep], total[keep]
    return i, j


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which listed pairs reach the threshold by the plain double-precision cosine."""
    ok = np.empty(len(i), bool)
    for s in range(0, len(i), 100_000):
        p, q = x[i[s:s + 100_000]], y[j[s:s + 100_000]]
        norm = np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q))
        ok[s:s + 100_000] = np.einsum("ij,ij->i", p, q) / norm >= threshold
    return ok


def _forest(i: np.ndarray, j: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n + m edges (rows first, then columns) that connect what the pairs connect."""
    label = np.arange(n + m)
    while True:
        least = np.minimum(label[i], label[n + j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, n + j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n + m))
    return node, label[node]


def compare(ia: np.ndarray, a: np.ndarray, ib: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float,
            same: bool) -> tuple[list, list]:
    """(links by id, connecting edges) between two tiles, or within one; nothing grows with the number of pairs."""
    ra, rb = _unit(a) @ turn, _unit(b) @ turn
    oa, ob = np.argsort(ra[:, 0], kind="stable"), np.argsort(rb[:, 0], kind="stable")
    ia, a, ra, ib, b, rb = ia[oa], a[oa], ra[oa], ib[ob], b[ob], rb[ob]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    edges = []
    for s in range(0, len(ia), BLOCK):
        for t in range(s if same else 0, len(ib), BLOCK):
            p, q = ra[s:s + BLOCK], rb[t:t + BLOCK]
            if q[0, 0] - p[-1, 0] > reach or p[0, 0] - q[-1, 0] > reach:
                continue
            found = _hits(p, q, threshold)
            i, j = np.nonzero(found) if isinstance(found, np.ndarray) else found
            if same and s == t:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            ok = _exact(a[s:s + BLOCK], b[t:t + BLOCK], i, j, threshold)
            i, j = i[ok], j[ok]
            na[s:s + BLOCK] += np.bincount(i, minlength=len(p))
            nb[t:t + BLOCK] += np.bincount(j, minlength=len(q))
            ids = np.concatenate([ia[s:s + BLOCK], ib[t:t + BLOCK]])
            u, v = _forest(i, j, len(p), len(q))
            edges.append(np.column_stack([ids[u], ids[v]]))
    return [(ia, na), (ib, nb)], edges


def links(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD,
          tile: int = TILE) -> DataFrame:
    """(a, b, n): b null and n links of vector a from one pair of tiles, or n null and an edge that connects a and b.

    Vectors of different sizes never link.  Stored in the shared folder.
    """
    rows = materialize(usable(vectors, key, column), "vectors")
    sizes = [r[0] for r in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect()]
    parts = [_links_of_size(rows.where(F.size("v") == size), size, threshold, tile) for size in sizes]
    out = rows.sparkSession.createDataFrame([], "a long, b long, n long")
    for part in parts:
        out = out.union(part)
    return materialize(out, "links")


def _links_of_size(rows: DataFrame, size: int, threshold: float, tile: int) -> DataFrame:
    turn = axes(rows, size)
    first = turn[:, 0].tolist()
    product = F.aggregate(F.zip_with("v", F.lit(first), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    placed = rows.withColumn("p", product / norm)
    n = placed.count()
    wanted = [k * tile / n for k in range(1, n // tile)]
    cuts = sorted(set(placed.approxQuantile("p", wanted, 0.01))) if wanted else []
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("p") > c).cast("int")
    placed = materialize(placed.withColumn("bucket", bucket), "placed")
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    # A crowded stretch of the axis is dealt over several tiles of bounded size.
    shares = {r["bucket"]: max(1, -(-r["n"] // tile)) for r in counts}
    share = F.lit(1)
    for b, s in shares.items():
        share = F.when(F.col("bucket") == b, s).otherwise(share)
    tiles = placed.select("id", "v", "bucket", F.pmod(F.xxhash64("id"), share).cast("int").alias("part"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "tile": [f"{group['bucket'].iloc[0]:08d}-{group['part'].iloc[0]:08d}"],
            "ids": [group["id"].to_numpy(np.int64).tobytes()], "v": [_stack(group["v"]).tobytes()],
        })

    packed = materialize(
        tiles.groupBy("bucket", "part").applyInPandas(pack, "tile string, ids binary, v binary"), "tiles"
    )
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    names = [(r["lo"], r["hi"], f"{r['bucket']:08d}-{k:08d}") for r in counts for k in range(shares[r["bucket"]])]
    near = [
        (x[2], y[2]) for x in names for y in names if x[2] <= y[2] and y[0] - x[1] <= reach and x[0] - y[1] <= reach
    ]
    spark = rows.sparkSession
    pairs = spark.createDataFrame(near or [("", "")], "x string, y string")
    left = pairs.join(packed, F.col("x") == F.col("tile")).select("x", "y", F.col("ids").alias("ia"), F.col("v").alias("va"))
    right = pairs.join(packed, F.col("y") == F.col("tile")).select("x", "y", F.col("ids").alias("ib"), F.col("v").alias("vb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ia, ib = np.frombuffer(r.ia, np.int64), np.frombuffer(r.ib, np.int64)
                a, b = np.frombuffer(r.va).reshape(-1, size), np.frombuffer(r.vb).reshape(-1, size)
                counted, edges = compare(ia, a, ib, b, turn, threshold, r.x == r.y)
                for ids, k in counted:
                    some = k > 0
                    yield pd.DataFrame({"a": ids[some], "b": pd.array([None] * int(some.sum()), "Int64"), "n": k[some]})
                for e in edges:
                    yield pd.DataFrame({"a": e[:, 0], "b": e[:, 1], "n": pd.array([None] * len(e), "Int64")})

    schema = T.StructType([T.StructField(c, T.LongType()) for c in "abn"])
    joined = left.join(right, ["x", "y"])
    return joined.select("x", "y", "ia", "va", "ib", "vb").mapInPandas(run, schema)


def deduplicate(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD,
                tile: int = TILE) -> DataFrame:
    """One row per input row: the key, n_links, component_id (the smallest key reachable) and kept.

    Null, zero and non-finite vectors link with nothing and stay alone, as do vectors under a null key.
    Rows that repeat a key are vectors of their own when compared and share one sum of links.  An
    empty table gives no rows.
    """
    found = links(vectors, key, column, threshold, tile)
    number = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n_links"))
    groups = graph.components(found.where("n IS NULL"), "a", "b")
    rows = vectors.select(F.col(key).cast("long").alias(key))
    out = rows.join(number, F.col(key) == number["a"], "left").join(groups, F.col(key) == groups["node"], "left")
    component = F.coalesce("component", F.col(key))
    return out.select(
        key, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col(key), F.lit(True)).alias("kept"),
    )
