"""Approximate nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to unit length, so the largest inner product is the largest cosine.
Product-quantiser codebooks of sixteen centroids for each pair of dimensions are fitted on
a bounded sample under the anisotropic loss (Guo et al., ICML 2020), which weighs the part
of the residual along the vector itself ETA times the part across it. Every vector is
encoded with four bits for each subspace; codes are assigned by coordinate descent under
the same loss. A search scans the codes of blocks of vectors with lookup tables for blocks
of queries, and the best of each block are ranked again by the exact cosine of the
original vectors in double precision.

Vectors that are null, zero or hold null or non-finite components take no part, neither as
query nor as candidate; nor do rows without an id. Vectors of another length than the most
frequent one take no part either. Ties go to the smaller id. Repeated rows count as
candidates of their own, but a query's own id is never among its neighbours; a query id that
stands in several rows asks with the least of its vectors. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastegraph.llm.labelled import spread
from tastegraph.plans.scratch import materialize, written

SAMPLE = 8000
CENTROIDS = 16
ETA = 4.0
ROUNDS = 12
#: Vectors of a scanned block, queries of a query block, vectors of a block that are ranked exactly for each query.
BLOCK, QUERIES, RERANK = 4096, 256, 64
SLACK = 0.01
#: Queries are broadcast in slices of up to this many bytes of vectors.
BROADCAST_BYTES = 64 << 20


def usable(column: str) -> F.Column:
    """True where an array<number> column is a vector that can be compared."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _split(x: np.ndarray) -> np.ndarray:
    """(n, subspaces, 2); an odd width is filled up with a zero."""
    if x.shape[1] % 2:
        x = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
    return x.reshape(len(x), -1, 2)


def assign(x: np.ndarray, books: np.ndarray, eta: float = ETA, sweeps: int = 2) -> np.ndarray:
    """Codes that lower ``|r|^2 + (eta - 1) <r, x>^2`` subspace by subspace; rows of ``x`` have unit length."""
    parts = _split(x)
    dist = ((parts[:, :, None, :] - books[None]) ** 2).sum(-1)
    along = np.einsum("nmd,mkd->nmk", parts, books)
    own = (parts**2).sum(-1)
    code = dist.argmin(-1)
    rows, subs = np.arange(len(x))[:, None], np.arange(parts.shape[1])
    par = own - along[rows, subs, code]
    total = par.sum(1)
    for _ in range(sweeps):
        for m in subs:
            option = own[:, m : m + 1] - along[:, m]
            cost = dist[:, m] + (eta - 1) * (total[:, None] - par[:, m : m + 1] + option) ** 2
            best = cost.argmin(1)
            total += option[rows[:, 0], best] - par[:, m]
            par[:, m] = option[rows[:, 0], best]
            code[:, m] = best
    return code.astype(np.uint8)


def fit_books(x: np.ndarray, eta: float = ETA, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (subspaces, 16, 2): alternating assignment and anisotropic least squares of each centroid."""
    parts = _split(x)
    rng = np.random.default_rng(5)
    books = parts[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        code = assign(x, books, eta, 1)
        rows = np.arange(len(x))
        residual = parts - books[np.arange(parts.shape[1])[None], code]
        par = (residual * parts).sum(-1)
        total = par.sum(1)
        for m in range(parts.shape[1]):
            p, rest = parts[:, m], total - par[:, m]
            # Minimise |p - c|^2 + (eta - 1)(rest + <p, p - c>)^2 over c for the rows of each centroid.
            w = np.eye(2)[None] + (eta - 1) * p[:, :, None] * p[:, None, :]
            rhs = p * (1 + (eta - 1) * (rest + (p * p).sum(1)))[:, None]
            a, b = np.zeros((CENTROIDS, 2, 2)), np.zeros((CENTROIDS, 2))
            np.add.at(a, code[:, m], w)
            np.add.at(b, code[:, m], rhs)
            used = np.bincount(code[:, m], minlength=CENTROIDS) > 0
            books[m, used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            fresh = ((p - books[m, code[rows, m]]) * p).sum(1)
            total += fresh - par[:, m]
            par[:, m] = fresh
    return books


def pack(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if code.shape[1] % 2:
        code = np.concatenate([code, np.zeros((len(code), 1), np.uint8)], axis=1)
    return code[:, ::2] | (code[:, 1::2] << 4)


def scan(queries: np.ndarray, packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, vectors) from the packed codes by table lookup, a byte at a time."""
    table = np.einsum("qmd,mkd->qmk", _split(queries), books).astype(np.float32)
    if table.shape[1] % 2:
        table = np.concatenate([table, np.zeros((len(table), 1, CENTROIDS), np.float32)], axis=1)
    joint = (table[:, 1::2, :, None] + table[:, ::2, None, :]).reshape(len(table), -1, 256)
    score = np.zeros((len(queries), len(packed)), np.float32)
    for b in range(packed.shape[1]):
        score += joint[:, b][:, packed[:, b]]
    return score


def best_of_block(q_ids, q, ids, x, packed, books, k, rerank=RERANK) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, cosine) of each query's best ``k`` in a block: a wide shortlist by code, then the exact cosine."""
    approx = scan(_unit(q), packed, books)
    width = min(len(ids), rerank)
    # Vectors with (nearly) the score of the last one on the list stand on it too, however many they are.
    floor = np.partition(approx, len(ids) - width, axis=1)[:, len(ids) - width] - SLACK
    q_norm, x_norm = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    out = []
    for r in range(len(q)):
        s = np.flatnonzero((approx[r] >= floor[r]) & (ids != q_ids[r]))
        exact = (x[s] * q[r]).sum(1) / (x_norm[s] * q_norm[r])
        order = np.lexsort((ids[s], -exact))[:k]
        out += [(int(q_ids[r]), int(ids[s[o]]), float(exact[o])) for o in order]
    return out


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each row whose id divides by ``every``."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    base = base.where("vec_id is not null").where(usable("x"))
    widths = base.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    width = widths["w"]
    base = base.where(F.size("x") == width)
    # Ids are drawn first and the vectors fetched by them, so that at most ``sample`` vectors reach the driver.
    drawn = base.join(F.broadcast(spread(base.select("vec_id"), sample, "vec_id")), "vec_id", "left_semi").limit(sample)
    fit_on = _unit(np.array([x for _, x in sorted((r["vec_id"], r["x"]) for r in drawn.collect())], float))
    books = fit_books(fit_on)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                x = np.array(part["x"].tolist(), float)
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "xs": [x.tobytes()], "codes": [pack(assign(_unit(x), books)).tobytes()]})

    def block_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), QUERIES):
                part = pdf.iloc[at : at + QUERIES]
                yield pd.DataFrame({"q_ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "qs": [np.array(part["x"].tolist(), float).tobytes()]})

    asked = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    n = asked.count()
    slices = max(1, -(-n * (width + 1) * 8 // BROADCAST_BYTES))
    indexed = base.mapInPandas(index, "ids binary, xs binary, codes binary")
    if slices > 1:  # each slice of the queries is a pass over the index
        asked, indexed = materialize(asked, "ann-queries"), materialize(indexed, "ann-index")

    def found_for(s: int) -> tuple[DataFrame, Broadcast]:
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == s).repartition(max(1, -(-n // (QUERIES * 8 * slices))))
        blocks = part.mapInPandas(block_queries, "q_ids binary, qs binary").collect()
        sent = spark.sparkContext.broadcast([(bytes(r["q_ids"]), bytes(r["qs"])) for r in blocks])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, list[tuple[float, int]]] = {}
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    ids = np.frombuffer(row.ids, np.int64)
                    x, packed = np.frombuffer(row.xs).reshape(-1, width), np.frombuffer(row.codes, np.uint8).reshape(len(ids), -1)
                    for q_ids, qs in sent.value:
                        q_ids = np.frombuffer(q_ids, np.int64)
                        for q, v, score in best_of_block(q_ids, np.frombuffer(qs).reshape(-1, width), ids, x, packed, books, k):
                            best.setdefault(q, []).append((-score, v))
                for q, found in best.items():
                    best[q] = sorted(found)[:k]
            rows = [(q, v, -score) for q, found in best.items() for score, v in found]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        return indexed.mapInPandas(search, "query_id long, vec_id long, score double"), sent

    found, sent = found_for(0)
    if slices > 1:  # written one after another, so that one slice's queries are held at a time
        found = written(found, sent, "ann-found")
        for s in range(1, slices):
            found = found.unionByName(written(*found_for(s), "ann-found"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
