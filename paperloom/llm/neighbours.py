"""The most similar vectors for every vector (problem 3).

An inverted file of coarse centroids with product-quantised residuals. A vector is normalised, assigned to its
nearest centroid, and its residual coded by one byte per subspace. A query visits the lists of its ``probes`` nearest
centroids; within a list its inner product with every code is summed from a table (query part x codebook); for many queries at once these
sums are taken as one product with the decoded rows, which is the same number. The best ``rerank`` of the
list are compared exactly, then every other row whose sum and quantisation error allow it to be as near as the
k-th of these; the best of all visited lists are merged.

How many lists must be visited depends on how the vectors lie. It is measured when the index is fitted: the exact neighbours of some
sampled rows among the sample, and, where a least cosine is asked for, rows turned away by just that, tell at which
place among a query's centroids the list of a neighbour stands; ``probes`` is the place that covers ``recall`` of them. So clustered vectors
and near duplicates take a few lists at any size, and the cost of a query grows with the length of a list, the root of the number of rows.

Vectors of the same direction are one class, of which one is indexed and searched; ranks are given after the classes are expanded
to their lowest keys. A row of a class with more than ``k`` others has its answer in the class and searches nothing.

Centroids and codebooks are fitted on a bounded sample (at most ``sample`` rows, the lowest hashes of the row key); every row
is indexed and every query row is answered. There are 2 sqrt(rows) lists, one for 16 sampled rows at most. Neighbouring lists are put together to
shards of about ``part`` rows, fewer where there are tasks to spare; a query travels once to each shard of which it visits a list, and brings
back its ``k`` best. A shard that holds a third of
all rows is cut into parts of about ``part`` rows, and its queries into blocks of as many; each part meets each block in a task of its own.
Vectors travel as half-precision numbers where that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

#: Classes of several rows up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_CLASSES = 100_000
#: Exact comparisons and summed distances held at once.
PAIRS, CELLS = 1 << 16, 1 << 22
#: More than the rounding of a summed distance in single precision.
SLACK = np.float32(1e-5)


def valid(embedding: Column, dim: int) -> Column:
    """``dim`` numbers, none null or NaN, finite, not all zero."""
    return F.coalesce(
        (F.size(embedding) == dim)
        & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Plain Lloyd rounds; empty clusters take a random row. ``k`` is lowered to the number of rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, c)
        n = np.bincount(of, minlength=k)
        order = np.argsort(of, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        c[full] = np.add.reduceat(x[order], starts[full]) / n[full, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def two_level(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centroids; many are found within coarse clusters, as many in each as it has rows, and moved once among all."""
    if k <= 1_024:
        return kmeans(x, k, 8, seed)
    top = kmeans(x, int(k**0.5), 8, seed)
    of = nearest(x, top)
    fine = [kmeans(x[of == i], max(1, round(k * (of == i).sum() / len(x))), 6, seed + 1 + i) for i in range(len(top)) if (of == i).any()]
    c = np.concatenate(fine)
    of = nearest(x, c)
    n = np.bincount(of, minlength=len(c))
    order, full = np.argsort(of, kind="stable"), n > 0
    c[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full]) / n[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    half = (c * c).sum(1) / 2
    for lo in range(0, len(x), 8192):
        out[lo : lo + 8192] = (x[lo : lo + 8192] @ c.T - half).argmax(1)
    return out


class Quantiser:
    """Coarse centroids, and codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int, seed: int) -> None:
        self.centroids = two_level(sample, lists, seed).astype(np.float32)
        rest = (sample - self.centroids[nearest(sample, self.centroids)]).astype(np.float32)
        self.subspaces, self.width = subspaces, sample.shape[1] // subspaces
        self.books = [kmeans(rest[: 40 * codes, self.part(s)], codes, 6, seed + 1 + s).astype(np.float32) for s in range(subspaces)]

    def part(self, s: int) -> slice:
        return slice(s * self.width, (s + 1) * self.width)

    def encode(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        rest = (x - self.centroids[of]).astype(np.float32)
        return np.stack([nearest(rest[:, self.part(s)], b) for s, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, of: np.ndarray | int, codes: np.ndarray) -> np.ndarray:
        return self.centroids[of] + np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)

    def errors(self, x: np.ndarray, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what the codes leave of each row: no inner product with a unit vector is further off."""
        return np.linalg.norm(x - self.decode(of, codes), axis=1).astype(np.float32)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        n = min(n, len(self.centroids))
        d = x @ self.centroids.T - (self.centroids**2).sum(1) / 2
        return np.argpartition(-d, n - 1, axis=1)[:, :n]

    def places(self, q: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Which place, from 0, each query's given list has among its nearest centroids."""
        out = np.empty(len(q), dtype=np.int64)
        half = (self.centroids**2).sum(1) / 2
        for lo in range(0, len(q), 1024):
            d = q[lo : lo + 1024].astype(np.float32) @ self.centroids.T - half
            own = d[np.arange(len(d)), lists[lo : lo + 1024]]
            out[lo : lo + 1024] = (d > own[:, None]).sum(1)
        return out

    def scores(self, q: np.ndarray, codes: np.ndarray, of: int, decoded: np.ndarray | None = None) -> np.ndarray:
        """Asymmetric inner products of queries with the coded rows of list ``of``, from tables or from the decoded rows."""
        if decoded is not None:
            return q @ decoded.T
        out = np.broadcast_to((q @ self.centroids[of])[:, None], (len(q), len(codes))).astype(np.float32)
        for s, b in enumerate(self.books):
            out += (q[:, self.part(s)] @ b.T)[:, codes[:, s]]
        return out


def pack(x: np.ndarray) -> list[bytes]:
    """The rows as bytes: in half precision where that is exact, else as they are."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half == x).all(axis=1)
    return [h.tobytes() if e else r.tobytes() for h, r, e in zip(half, x, exact)]


def unpack(v: list[bytes] | pd.Series, dim: int, real: type) -> np.ndarray:
    """Unit vectors of what :func:`pack` gave."""
    v = list(v)
    short = np.fromiter((len(b) == 2 * dim for b in v), bool, len(v))
    out = np.empty((len(v), dim))
    for kind, rows in ((np.float16, np.flatnonzero(short)), (real, np.flatnonzero(~short))):
        if len(rows):
            out[rows] = np.frombuffer(b"".join(v[i] for i in rows), dtype=kind).reshape(-1, dim)
    return unit(out)


def fit(vectors: DataFrame, key: str, embedding: str, dim: int, rows: int, sample: int, subspaces: int, codes: int, seed: int,
        real: type = np.float32) -> tuple[Quantiser, np.ndarray]:
    """(index model, sampled unit vectors): 40,000 rows or 16 for each of 2 sqrt(rows) lists, at most ``sample``, those with the lowest key hashes."""
    lists = max(1, int(min(2 * rows**0.5, sample / 16)))
    got = vectors.select(F.xxhash64(key, F.lit(seed)).alias("h"), embedding).orderBy("h").limit(min(sample, max(40_000, 16 * lists))).toArrow()
    x = unpack(got.column(embedding).to_pylist(), dim, real)
    return Quantiser(x, max(1, min(lists, len(x) // 16)), subspaces, min(codes, len(x)), seed), x


def needed_probes(model: Quantiser, x: np.ndarray, k: int, floor: float, recall: float, seed: int, queries: int = 1_000) -> int:
    """How many lists a query visits to meet ``recall`` of its neighbours, measured on the sampled unit vectors ``x``.

    Neighbours are the ``k`` nearest in the sample, with a cosine of ``floor`` at least. For a positive floor there are also, for every query,
    four rows turned away from it at random by just the floor, and the larger number counts.
    """
    rng = np.random.default_rng(seed)
    ask = rng.choice(len(x), min(queries, len(x)), replace=False)
    q, of = x[ask], nearest(x, model.centroids)
    k = min(k, len(x) - 1)
    places = []
    if k > 0:
        pairs, of_k = [], []
        for lo in range(0, len(q), 256):
            cos = q[lo : lo + 256] @ x.T
            cos[np.arange(len(cos)), ask[lo : lo + 256]] = -2
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            row, col = np.nonzero(np.take_along_axis(cos, top, 1) >= floor)
            pairs.append(lo + row)
            of_k.append(of[top[row, col]])
        places.append(model.places(q[np.concatenate(pairs)], np.concatenate(of_k)))
    if floor > 0:
        a = np.repeat(q, 4, axis=0)
        away = rng.normal(size=a.shape)
        away -= (away * a).sum(1, keepdims=True) * a
        turned = floor * a + np.sqrt(max(0.0, 1 - floor**2)) * away / np.linalg.norm(away, axis=1, keepdims=True)
        places.append(model.places(a, nearest(turned, model.centroids)))
    return 1 + max((int(np.quantile(p, recall, method="higher")) for p in places if len(p)), default=len(model.centroids) - 1)


def nearest_of_list(q: np.ndarray, own: np.ndarray, base: np.ndarray, scores: np.ndarray, errors: np.ndarray,
                    k: int, rerank: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the ``k`` nearest rows of each query with a cosine of ``floor`` or more, ties by lower row.

    ``own`` is each query's own row, or -1. Exact: a row is left out only if its score and error keep it below the k-th.
    """
    rerank = max(rerank, k + 1)
    most = scores + (errors + SLACK)
    least = np.full(len(q), floor)
    many = np.flatnonzero((most >= floor).sum(1) > rerank)
    if len(many):
        best = np.argpartition(-scores[many], rerank - 1, axis=1)[:, :rerank]
        for lo in range(0, len(many), max(1, PAIRS // rerank)):
            part, at = many[lo : lo + max(1, PAIRS // rerank)], best[lo : lo + max(1, PAIRS // rerank)]
            cos = np.einsum("qd,qnd->qn", q[part], base[at])
            cos[at == own[part, None]] = -2  # not the row itself
            least[part] = np.maximum(floor, np.partition(cos, rerank - k, axis=1)[:, rerank - k] - 1e-11)
    row, col = np.nonzero(most >= least[:, None])
    other = col != own[row]
    row, col = row[other], col[other]
    if len(row) * 8 > most.size:
        cos = (q @ base.T)[row, col]
    else:
        cos = np.empty(len(row))
        for lo in range(0, len(row), PAIRS):
            r, c = row[lo : lo + PAIRS], col[lo : lo + PAIRS]
            cos[lo : lo + PAIRS] = np.einsum("nd,nd->n", q[r], base[c])
    cos = np.round(cos, 12)
    keep = cos >= least[row]
    row, col, cos = row[keep], col[keep], cos[keep]
    order = np.lexsort((col, -cos, row))
    row, col, cos = row[order], col[order], cos[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], col[top], cos[top]


def most_similar(vectors: DataFrame, key: str = "row_no", embedding: str = "embedding", k: int = 5, dim: int = 64,
                 probes: int | None = None, recall: float = 0.98, rerank: int = 40, sample: int = 400_000, subspaces: int = 16, codes: int = 256,
                 part: int = 20_000, queries: Column | None = None, seed: int = 7, floor: float = -1.0) -> DataFrame:
    """(key, other, cosine, rank): the ``k`` most similar other valid rows of each valid row, ties by lower key.

    ``probes`` lists are visited, by default as many as ``recall`` needs on the sample; more raise recall and cost.
    ``queries`` restricts the rows asked for; all rows are searched. Only rows with a cosine of ``floor`` or more are given.
    Invalid vectors (null, of other length, with null, NaN
    or infinite numbers, all zero) are neither asked for nor found. Several rows of one key count as one (any of
    them). Similarity is the exact cosine of the candidates found, in double precision rounded to 12 digits; vectors of the same
    direction have 1.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    vectors = vectors.where(F.col(key).isNotNull() & valid(F.col(embedding), dim)).select(
        F.col(key).alias("key"), F.col(embedding).alias("v"),
        (queries if queries is not None else F.lit(True)).alias("ask"))
    real = np.float32 if vectors.schema["v"].dataType.elementType.simpleString() == "float" else np.float64

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_numpy()).astype(real)
                x = np.round(unit(v), 12) + 0.0  # no negative zeros
                yield pd.DataFrame({"key": b["key"], "ask": b["ask"], "v": pack(v),
                                    "same": [xxhash.xxh3_128_digest(r.tobytes()) for r in x]})

    rows = cut(vectors.dropDuplicates(["key"]).mapInPandas(packed, f"key {kind}, ask boolean, v binary, same binary"))
    # The lowest keys of a class, with whether they ask: all of them in a class of up to k.
    first = Window.partitionBy("same").orderBy("key")
    classes = cut(rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).groupBy("same").agg(
        F.min("key").alias("key"), F.min_by("v", "key").alias("v"), F.sort_array(F.collect_list(F.struct("key", "ask"))).alias("members")
    ).withColumn("ask", (F.size("members") <= k) & F.exists("members", lambda m: m["ask"])))
    count = classes.count()
    schema = f"{key} {kind}, other {kind}, cosine double, rank int"
    if not count:
        return spark.createDataFrame([], schema)
    fitted, sampled = fit(classes, "key", "v", dim, count, sample, subspaces, codes, seed, real)
    probes = probes or needed_probes(fitted, sampled, k, floor, recall, seed)
    model = spark.sparkContext.broadcast(fitted)
    shards = max(-(-count // part), min(4 * spark.sparkContext.defaultParallelism, count // 500))
    shard_of = nearest(fitted.centroids, two_level(fitted.centroids, max(1, min(shards, len(fitted.centroids))), seed))
    # Large shards are cut into parts and much asked ones into blocks of queries; each part meets each block. How many follows from the sample.
    own, seen = shard_of[nearest(sampled, fitted.centroids)], np.zeros(shard_of.max() + 1)
    for lo in range(0, len(sampled), 1024):
        near = shard_of[fitted.probes(sampled[lo : lo + 1024], probes)]
        seen += np.bincount(np.concatenate([np.unique(x) for x in near]), minlength=len(seen))
    many = lambda n, rows: np.maximum(1, np.ceil(n / len(sampled) * rows / part)).astype(np.int32)
    parts, blocks = many(np.bincount(own, minlength=len(seen)), count), many(seen, classes.where("ask").count())

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Quantiser = model.value
        for b in batches:
            if len(b):
                x = unpack(b["v"], dim, real)
                of = nearest(x, m.centroids)
                code = m.encode(x, of)
                yield pd.DataFrame({"shard": shard_of[of], "parts": parts[shard_of[of]], "blocks": blocks[shard_of[of]], "list": of, "key": b["key"], "v": b["v"],
                                    "code": [c.tobytes() for c in code], "error": m.errors(x, of, code)})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Quantiser = model.value
        for b in batches:
            for lo in range(0, len(b), 2048):
                some = b.iloc[lo : lo + 2048]
                near = m.probes(unpack(some["v"], dim, real), probes)
                near = np.take_along_axis(near, np.argsort(shard_of[near], axis=1, kind="stable"), 1)
                shard, row = shard_of[near].ravel(), np.repeat(np.arange(len(some)), near.shape[1])
                edge = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                flat, ends = near.ravel().astype(np.int32).tobytes(), [*(edge[1:] * 4).tolist(), near.size * 4]
                yield pd.DataFrame({"shard": shard[edge], "parts": parts[shard[edge]], "blocks": blocks[shard[edge]], "q_key": some["key"].to_numpy()[row[edge]],
                                    "q_v": some["v"].to_numpy()[row[edge]], "lists": [flat[a:z] for a, z in zip((edge * 4).tolist(), ends)]})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    stored = classes.select("key", "v").mapInPandas(index, f"shard int, parts int, blocks int, list int, key {kind}, v binary, code binary, error float").select(
        "shard", dealt("key", "parts").alias("part"), each("blocks").alias("block"), "list", "key", "v", "code", "error")
    asked = classes.where("ask").select("key", "v").mapInPandas(visit, f"shard int, parts int, blocks int, q_key {kind}, q_v binary, lists binary").select(
        "shard", each("parts").alias("part"), dealt("q_key", "blocks").alias("block"), "q_key", "q_v", "lists")

    def search(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        m: Quantiser = model.value
        none = pd.DataFrame({"key": [], "other": [], "cosine": []})
        if not len(left) or not len(right):
            return none
        left = left.sort_values(["list", "key"], kind="stable")
        base, ids, errors, lists = unpack(left["v"], dim, real), left["key"].to_numpy(), left["error"].to_numpy(), left["list"].to_numpy()
        codes_ = np.frombuffer(b"".join(left["code"]), dtype=np.uint8).reshape(len(left), -1)
        ask, q = right["q_key"].to_numpy(), unpack(right["q_v"], dim, real)
        own = pd.Index(ids).get_indexer(ask)
        wanted = np.frombuffer(b"".join(right["lists"]), dtype=np.int32)
        by = np.repeat(np.arange(len(ask)), [len(x) // 4 for x in right["lists"]])
        order = np.argsort(wanted, kind="stable")
        wanted, by = wanted[order], by[order]
        out: list[list[np.ndarray]] = [[], [], []]
        for of in np.unique(lists):
            lo, hi = np.searchsorted(lists, [of, of + 1])
            visiting = by[slice(*np.searchsorted(wanted, [of, of + 1]))]
            decoded = m.decode(of, codes_[lo:hi]) if len(visiting) > 16 else None
            block = max(1, min(2048, CELLS // int(hi - lo)))
            for at in range(0, len(visiting), block):
                some = visiting[at : at + block]
                mine = np.where((own[some] >= lo) & (own[some] < hi), own[some] - lo, -1)
                row, col, cos = nearest_of_list(q[some], mine, base[lo:hi], m.scores(q[some].astype(np.float32), codes_[lo:hi], of, decoded), errors[lo:hi], k, rerank, floor)
                for x, y in zip(out, (some[row], lo + col, cos)):
                    x.append(y)
        if not out[0]:
            return none
        row, col, cos = (np.concatenate(x) for x in out)
        order = np.lexsort((ids[col], -cos, row))
        row, col, cos = row[order], col[order], cos[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"key": ask[row[top]], "other": ids[col[top]], "cosine": cos[top]})

    found = stored.groupBy("shard", "part", "block").cogroup(asked.groupBy("shard", "part", "block")).applyInPandas(
        search, f"key {kind}, other {kind}, cosine double")
    w = Window.partitionBy("key").orderBy(F.desc("cosine"), F.asc("other"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    # Of equally near classes the k with the lowest first keys hold the k lowest keys.
    several = classes.where(F.size("members") > 1).select("same", F.col("key").alias("first"), "members")
    if several.count() <= BROADCAST_CLASSES:
        several = F.broadcast(several)
    lowest = F.col("members.key")
    best = best.join(several.select(F.col("first").alias("other"), lowest.alias("others")), "other", "left").join(
        several.select(F.col("first").alias("key"), F.filter("members", lambda m: m["ask"])["key"].alias("keys")), "key", "left")
    best = best.select(F.explode(F.coalesce("keys", F.array("key"))).alias("key"), F.coalesce("others", F.array("other")).alias("others"), "cosine").select(
        "key", F.explode("others").alias("other"), "cosine")
    within = rows.where("ask").select("key", "same").join(several.select("same", lowest.alias("others")), "same").select(
        "key", F.explode("others").alias("other"), F.lit(1.0).alias("cosine")).where(F.col("key") != F.col("other"))
    return (
        best.unionByName(within).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select(F.col("key").alias(key), "other", "cosine", "rank")
    )
