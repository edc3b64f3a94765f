"""The k most similar vectors of every vector, by additive quantisation and exact reranking.

A vector is approximated by a sum of full-dimensional codewords, one of each codebook: two coarse ones, which together
name the list the vector is kept in, and ``books`` residual ones. The codebooks are trained on a bounded sample by
k-means on residuals, and the residual ones then refitted together by least squares; codes are found by beam search.
With the vector go its codes and the norm of the approximation. In a list, a query scores the members by tables of its
inner products with all codewords, and the best ``rerank`` are compared exactly, in double precision.

The second coarse codebook is shared by all words of the first, so the number of lists can grow with the square root of
the number of vectors while the sample stays bounded.

The larger the collection, the fewer of its groups the sample has seen; the centres tell the members of such a group
apart by little more than chance. A vector is therefore held in all of its nearest lists that are about as near as the
nearest one: in one where the sample knows its group, in several elsewhere.

A vector is first searched in its nearest list, where it lies already. What it finds there says how similar a member of
another list would have to be; of the next nearest lists, only those whose centre and spread allow that are visited.

Equal vectors are searched once. A list is cut into blocks of members and of queries, so one list that holds a large
share of all vectors is many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landweave.session import cut_lineage, ship


@dataclass
class AdditiveQuantiser:
    """``coarse`` (c x d) and ``fine`` (f x d), whose sums are the centres of c x f lists, and ``books`` (m x k x d)."""

    coarse: np.ndarray
    fine: np.ndarray
    books: np.ndarray

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of each row, nearest first, among those of its n nearest coarse words."""
        score = x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)
        n0 = min(n, score.shape[1])
        words = np.argpartition(-score, n0 - 1, axis=1)[:, :n0]
        if len(self.fine) > 1:  # |x - c - f|^2 needs the inner products of coarse and fine words too
            part = np.take_along_axis(score, words, 1)[:, :, None] + (x @ self.fine.T - 0.5 * (self.fine**2).sum(1))[:, None, :] - (self.coarse @ self.fine.T)[words]
            lists = words[:, :, None] * len(self.fine) + np.arange(len(self.fine))
            part, lists = part.reshape(len(x), -1), lists.reshape(len(x), -1)
        else:
            part, lists = np.take_along_axis(score, words, 1), words
        n1 = min(n, part.shape[1])
        best = np.argpartition(-part, n1 - 1, axis=1)[:, :n1]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(part, best, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(lists, best, 1)

    def encode(self, x: np.ndarray, lists: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes (n x m) of residuals by beam search: of all continuations, the ``beam`` of least error are kept."""
        rest = (x - self.centre(lists))[:, None, :]
        codes = np.zeros((len(x), 1, 0), np.int16)
        for book in self.books:
            error = (rest**2).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(1)
            n, b, k = error.shape
            flat, keep = error.reshape(n, b * k), min(beam, b * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            at, word = best // k, best % k
            rows = np.arange(n)[:, None]
            rest = rest[rows, at] - book[word]
            codes = np.concatenate([codes[rows, at], word[:, :, None].astype(np.int16)], axis=2)
        return codes[np.arange(len(x)), (rest**2).sum(2).argmin(1)]

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centre(lists) + sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all residual codewords: m x k x queries."""
        return self.books @ q.T


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = np.concatenate([(x[i : i + 8192] @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1) for i in range(0, len(x), 8192)])
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centres))]).astype(np.float32)
    return centres


def fit(x: np.ndarray, lists: int, books: int = 4, words: int = 128, rounds: int = 8, seed: int = 7) -> AdditiveQuantiser:
    """Codebooks from a sample of unit vectors: residual k-means, then one joint least-squares refit.

    The first coarse codebook has a word per 16 vectors of the sample at most; the second makes up for the rest."""
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float32)
    first = max(1, min(lists, len(x) // 16))
    coarse = k_means(x, first, rounds, rng)
    zero = np.zeros((1, x.shape[1]), np.float32)
    model = AdditiveQuantiser(coarse, zero, np.zeros((0, 1, x.shape[1]), np.float32))
    of = np.concatenate([model.nearest_lists(x[i : i + 8192], 1)[:, 0] for i in range(0, len(x), 8192)])
    if lists > first:
        model.fine = k_means(x - coarse[of], -(-lists // first), rounds, rng)
        of = np.concatenate([model.nearest_lists(x[i : i + 2048], 1)[:, 0] for i in range(0, len(x), 2048)])
    centre = model.centre(of)
    rest, residual_books = x - centre, []
    for _ in range(books):
        book = k_means(rest, words, rounds, rng)
        residual_books.append(np.pad(book, ((0, words - len(book)), (0, 0))))
        rest = rest - book[(rest @ book.T - 0.5 * (book**2).sum(1)).argmax(1)]
    model.books = np.stack(residual_books).astype(np.float32)
    codes = np.concatenate([model.encode(x[i : i + 4096], of[i : i + 4096]) for i in range(0, len(x), 4096)])
    flat = codes.astype(np.int64) + np.arange(books) * words
    gram = np.eye(books * words) * 0.1
    for a in range(books):
        for b in range(books):
            np.add.at(gram, (flat[:, a], flat[:, b]), 1.0)
    right = 0.1 * model.books.reshape(books * words, -1).astype(np.float64)
    for a in range(books):
        np.add.at(right, flat[:, a], (x - centre).astype(np.float64))
    model.books = np.linalg.solve(gram, right).reshape(model.books.shape).astype(np.float32)
    return model


def search_block(model: AdditiveQuantiser, members: dict, queries: dict, k: int, rerank: int, step: int = 1024):
    """Of a block of one list: query number, member number and exact cosine (6 decimals) of the k best per query."""
    x, codes, norms = members["x"], members["codes"], members["norm"]
    homes, home = np.unique(members["home"], return_inverse=True)
    centres = model.centre(homes)
    for i in range(0, len(queries["x"]), step):
        q = queries["x"][i : i + step]
        table = model.tables(q)
        score = (centres @ q.T)[home] + sum(table[m][codes[:, m]] for m in range(codes.shape[1]))
        score /= norms[:, None]
        r = min(rerank, len(x))
        near = np.argpartition(-score, r - 1, axis=0)[:r].T
        exact = np.concatenate([np.einsum("qd,qrd->qr", queries["unit"][i + j : i + j + 128], members["unit"][near[j : j + 128]]) for j in range(0, len(q), 128)]).round(6)
        order = np.lexsort((members["first"][near], -exact), axis=1)[:, :k]
        yield np.repeat(np.arange(i, i + len(q)), order.shape[1]), np.take_along_axis(near, order, 1).ravel(), np.take_along_axis(exact, order, 1).ravel()


def _matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distinct_vectors(df: DataFrame, key: str, vector: str, dim: int, copies: int) -> tuple[DataFrame, DataFrame]:
    """(rows (id, cls), classes (cls, embedding, ids)): classes of equal vectors with their ``copies`` smallest ids.

    Vectors that are null, of another length, of norm 0 or with a null or non-finite number take no part."""
    v = F.col(vector)
    norm2 = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ok = df.select(F.col(key).alias("id"), v.alias("embedding"), norm2.alias("_n2")).where((F.size(v) == dim) & F.col("id").isNotNull()).where("_n2 > 0 and _n2 < double('Infinity')")
    # two 64-bit hashes of the whole vector: rows of one class are equal but for a chance of 2^-128 a pair
    rows = ok.select("id", "embedding", F.struct(F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), F.reverse("embedding")).alias("h2")).alias("cls"))
    # the limit is applied before the shuffle too, so many copies of one vector move little
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("cls").orderBy("id"))).where(F.col("_r") <= copies)
    classes = first.groupBy("cls").agg(F.min_by("embedding", "id").alias("embedding"), F.sort_array(F.collect_list("id")).alias("ids"))
    return rows.select("id", "cls"), classes


def nearest(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", dim: int = 128, k: int = 5, probes: int = 12, rerank: int = 96, reach: float = 0.75, sample: int = 32768, block: int = 4096, spill: int = 8, slack: float = 0.05) -> DataFrame:
    """(id, neighbour, cosine): of every vector the k others most similar by cosine, rounded to 6 decimals, of equal
    ones those of smaller id. Approximate: what lies in none of the visited lists, or far down in one, is missed.

    ``sample``: the codebooks are fitted on at most so many rows; all rows are indexed and all are queries. The number
    of lists is four times the square root of the number of vectors. ``probes``: how many lists are considered.
    ``spill``, ``slack``: a vector is held in up to so many of them, whose centres are farther than the nearest one by no
    more than this share.
    ``reach``: one beyond a vector's own is visited if the inner product with its centre plus this share of its greatest
    residual is no less than the k-th cosine found so far; at 1 none is left out that can hold anything nearer. Empty
    input gives no rows."""
    ship(df)
    rows, classes = distinct_vectors(df, key, vector, dim, k + 1)
    classes = cut_lineage(classes)
    n = classes.count()
    if n == 0:
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine")).limit(0)
    share = min(1.0, 1.2 * sample / n)
    drawn = classes.where(F.pmod(F.col("cls.h1"), F.lit(1 << 20)) < share * (1 << 20)).select("embedding").limit(sample).toPandas()["embedding"]
    if len(drawn) == 0:
        drawn = classes.select("embedding").limit(sample).toPandas()["embedding"]
    x = _unit(np.stack(drawn.to_numpy()).astype(np.float32)).astype(np.float32)
    model = fit(x, max(1, round(4 * math.sqrt(n))))
    shared = df.sparkSession.sparkContext.broadcast(model)  # codebooks: bounded by the sample, but for a word per sample / 16 lists

    def encode(batches):
        m = shared.value
        for pdf in batches:
            raw = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
            for i in range(0, len(raw), 2048):
                part = raw[i : i + 2048]
                unit = _unit(part).astype(np.float32)
                lists = m.nearest_lists(unit, probes)
                codes = m.encode(unit, lists[:, 0])
                norm = np.linalg.norm(m.decode(lists[:, 0], codes), axis=1)
                far = np.stack([np.linalg.norm(unit - m.centre(lists[:, j]), axis=1) for j in range(min(spill, lists.shape[1]))], axis=1)
                near = np.maximum((far <= (1 + slack) * far[:, :1]).cumprod(axis=1).sum(axis=1), 1)
                met = np.stack([(unit * m.centre(lists[:, j])).sum(1) for j in range(lists.shape[1])], axis=1)
                yield pd.DataFrame({"cls": pdf["cls"].iloc[i : i + 2048], "ids": pdf["ids"].iloc[i : i + 2048], "vec": [r.tobytes() for r in part], "codes": [c.tobytes() for c in codes], "norm": np.maximum(norm, 1e-6), "spreads": [r[:h] for r, h in zip(far.astype(np.float64), near, strict=True)], "lists": list(lists.astype(np.int32)), "met": list(met.astype(np.float32))})

    packed = classes.select(F.struct("cls.h1", "cls.h2").alias("cls"), "ids", "embedding").mapInPandas(_struct_safe(encode), "h1 bigint, h2 bigint, ids array<bigint>, vec binary, codes binary, norm double, spreads array<double>, lists array<int>, met array<float>")
    index = cut_lineage(packed)

    def search(mem: pd.DataFrame, que: pd.DataFrame) -> pd.DataFrame:
        if mem.empty or que.empty:
            return pd.DataFrame({c: [] for c in ("h1", "h2", "first", "ids", "cosine")})
        m = shared.value
        xm, xq = _matrix(mem["vec"], dim), _matrix(que["q_vec"], dim)
        um, uq = _unit(xm), _unit(xq)
        codes = np.frombuffer(b"".join(mem["codes"]), np.int16).reshape(len(mem), -1)
        side = {"x": xm, "unit": um, "codes": codes, "norm": mem["norm"].to_numpy(np.float32), "first": mem["first"].to_numpy(), "home": mem["home"].to_numpy()}
        found = list(search_block(m, side, {"x": uq.astype(np.float32), "unit": uq}, k + 1, rerank))
        q, r, cos = (np.concatenate(p) for p in zip(*found, strict=True))
        return pd.DataFrame({"h1": que["h1"].to_numpy()[q], "h2": que["h2"].to_numpy()[q], "first": mem["first"].to_numpy()[r], "ids": mem["ids"].to_numpy()[r], "cosine": cos})

    def visit(queries: DataFrame) -> DataFrame:
        """What queries (h1, h2, vec, list) find in their lists, by blocks of members and of queries of a list."""
        asked = queries.groupBy("list").agg(F.count(F.lit(1)).alias("q"))
        # one row per list, of which there are four times the square root of the number of vectors
        cut = held.join(asked, "list").select("list", F.greatest(F.ceil(F.col("m") / block), F.lit(1)).cast("int").alias("mb"), F.greatest(F.ceil(F.col("q") / (4 * block)), F.lit(1)).cast("int").alias("qb"))
        members = index.withColumn("list", F.explode(F.slice("lists", 1, F.size("spreads")))).join(F.broadcast(cut), "list").select("list", F.col("lists")[0].alias("home"), F.pmod("h1", "mb").cast("int").alias("mi"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qi"), F.col("ids")[0].alias("first"), "ids", "vec", "codes", "norm")
        sent = queries.join(F.broadcast(cut), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mi"), F.pmod("h2", "qb").cast("int").alias("qi"), "h1", "h2", "vec").toDF("q_list", "q_mi", "q_qi", "h1", "h2", "q_vec")
        return members.groupBy("list", "mi", "qi").cogroup(sent.groupBy("q_list", "q_mi", "q_qi")).applyInPandas(lambda a, b: search(a, b), "h1 bigint, h2 bigint, first bigint, ids array<bigint>, cosine double")

    held = index.select("lists", F.posexplode("spreads").alias("_i", "spread")).groupBy(F.col("lists")[F.col("_i")].alias("list")).agg(F.count(F.lit(1)).alias("m"), F.max("spread").alias("spread"))
    at_home = cut_lineage(visit(index.select("h1", "h2", "vec", F.col("lists")[0].alias("list"))))
    # a class counts for its copies: the cosine that k others reach, or none if there are fewer
    ranks = W.partitionBy("h1", "h2").orderBy(F.desc("cosine"), "first").rowsBetween(W.unboundedPreceding, 0)
    enough = at_home.select("h1", "h2", "cosine", F.sum(F.size("ids")).over(ranks).alias("_n")).where(F.col("_n") > k).groupBy("h1", "h2").agg(F.max("cosine").alias("kth"))
    further = index.join(enough, ["h1", "h2"], "left").select("h1", "h2", "vec", "kth", F.explode(F.slice(F.arrays_zip("lists", "met"), 2, probes)).alias("l"))
    further = further.select("h1", "h2", "vec", "kth", F.col("l.lists").alias("list"), F.col("l.met").alias("_met")).join(F.broadcast(held.select("list", "spread")), "list")
    abroad = visit(further.where(F.col("kth").isNull() | (F.col("_met") + reach * F.col("spread") >= F.col("kth"))).select("h1", "h2", "vec", "list"))
    # a member that is held in several lists may be met in each
    met = at_home.unionByName(abroad).repartition("h1", "h2").groupBy("h1", "h2", "first").agg(F.max("cosine").alias("cosine"), F.first("ids").alias("ids"))
    best = met.withColumn("_r", F.row_number().over(W.partitionBy("h1", "h2").orderBy(F.desc("cosine"), "first"))).where(F.col("_r") <= k + 1)
    # bounded: at most k + 1 classes of at most k + 1 ids
    ranked = best.groupBy("h1", "h2").agg(F.collect_list(F.struct("cosine", "ids")).alias("_c"))
    flat = F.flatten(F.transform("_c", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["cosine"]).alias("far"), i.alias("id")))))
    lists = ranked.select(F.struct("h1", "h2").alias("cls"), F.slice(F.array_sort(flat), 1, k + 1).alias("near"))
    own = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return rows.join(lists, "cls").select("id", F.explode(own).alias("x")).select("id", F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("cosine"))


def _struct_safe(encode):
    """Splits the class struct, which pandas holds as dicts, into two columns of numbers."""

    def run(batches):
        for out in encode(batches):
            cls = out.pop("cls")
            out.insert(0, "h1", [c["h1"] for c in cls])
            out.insert(1, "h2", [c["h2"] for c in cls])
            yield out

    return run


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b): pairs, smaller id first, of which one is among the nearest of the other."""
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()
