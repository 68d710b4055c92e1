"""Cosine nearest neighbours, votes, cascades and distributions over embeddings.

Queries travel to the references: blocks of at most ``block_rows`` query vectors
(a bound on what is broadcast) are taken one after the other, and each is held
against all references where they lie, an Arrow batch at a time, in matrix products
of about ``TILE`` similarities, so no reference is shuffled. A task keeps the best k
of every query over all its batches, so a query yields at most k rows a task, and the
final top k is a small window. Where candidates are restricted to a pool, the products are taken pool by
pool. No pair of rows is emitted but these. Ties: similarity, then the smaller
reference; votes, then the code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from adagium.shared import materialize

TOP = "q long, ref long, sim double"
#: Similarities that a task holds at once: 16 MB, at any number of queries and references.
TILE = 1 << 21


def unit(v: Column) -> Column:
    """A vector of length 1; zero vectors stay."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, ids) of the k best columns of each row; -inf and -1 where there are fewer."""
    n, m = sim.shape
    if m > k:
        least = np.partition(sim, m - k, axis=1)[:, m - k]
        row, col = np.nonzero(sim >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(sim.shape))
    own = np.broadcast_to(ids, sim.shape)[row, col]
    order = np.lexsort((own, -sim[row, col], row))
    row, col, own = row[order], col[order], own[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    keep = place < k
    out, names = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    out[row[keep], place[keep]], names[row[keep], place[keep]] = sim[row[keep], col[keep]], own[keep]
    return out, names


def _units(vectors) -> np.ndarray:
    v = np.array([np.asarray(x, dtype=np.float64) for x in vectors])
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1.0)


def _padded(v: np.ndarray) -> np.ndarray:
    """Zero rows up to a multiple of 64: a product's last bits then don't depend on its rows' places, and copies tie."""
    return np.concatenate([v, np.zeros((-len(v) % 64, v.shape[1]))])


def _query_blocks(queries: DataFrame, columns: list, pool: list[str], block_rows: int):
    """{pool values: (ids, unit vectors, excluded values)} of each block of queries, streamed to the driver."""
    block: dict[tuple, list] = {}
    n = 0
    for r in queries.select(*columns, *pool).toLocalIterator():
        block.setdefault(tuple(r[3 : 3 + len(pool)]), []).append(r[:3])
        n += 1
        if n == block_rows:
            yield block
            block, n = {}, 0
    if n:
        yield block


def neighbours(queries: DataFrame, refs: DataFrame, k: int = 15, query_key: str = "q", ref_key: str = "ref", vector: str = "embedding", pool: list[str] = [], block_rows: int = 16384, exclude: str | None = None) -> DataFrame:
    """(pool, q, ref, sim, rank): the k nearest refs of each query, within its pool columns if given.

    exclude: a column of both; refs with the query's value are no candidates. null vectors have no neighbours.
    """
    spark = refs.sparkSession
    side = lambda df, key: [F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), (F.col(exclude).cast("string") if exclude else F.lit(None).cast("string")).alias("x")]
    known = refs.filter(F.col(vector).isNotNull()).select(*side(refs, ref_key), *pool)
    fields = ", ".join([TOP, *[f"{p} {dict(queries.dtypes)[p]}" for p in pool]])

    def searched(block):
        shared = spark.sparkContext.broadcast({g: (np.array([r[0] for r in rows], dtype=np.int64), _units([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=object)) for g, rows in block.items()})

        def best(batches):
            import pandas as pd

            found = {g: (np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)) for g, (ids, _, _) in shared.value.items()}
            for pdf in batches:
                for g, (ids, q, x) in shared.value.items():
                    own = pdf
                    for p, value in zip(pool, g):
                        own = own[own[p] == value]
                    if not len(own):
                        continue
                    names, others = own["id"].to_numpy(np.int64), own["x"].to_numpy(dtype=object)
                    unit_refs = _padded(_units(own["v"])).T
                    rows = max(64, TILE // len(own) // 64 * 64)
                    for at in range(0, len(ids), rows):
                        part = slice(at, at + rows)
                        sim = (_padded(q[part]) @ unit_refs)[: len(ids[part]), : len(own)]
                        if exclude:
                            sim[x[part, None] == others[None, :]] = -np.inf
                        for best_yet, top in zip(found[g], _merge(tuple(b[part] for b in found[g]), _best(sim, names, k), k)):
                            best_yet[part] = top
            for g, (sim, names) in found.items():
                row, col = np.nonzero(np.isfinite(sim))
                out = pd.DataFrame({"q": shared.value[g][0][row], "ref": names[row, col], "sim": sim[row, col]})
                for p, value in zip(pool, g):
                    out[p] = value
                yield out

        return known.mapInPandas(best, fields)

    near = None
    for block in _query_blocks(queries.filter(F.col(vector).isNotNull()), side(queries, query_key), pool, block_rows):
        more = searched(block)
        near = more if near is None else near.unionByName(more)
    if near is None:
        near = spark.createDataFrame([], fields)
    w = W.partitionBy(*pool, "q").orderBy(F.desc("sim"), "ref")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _merge(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists a row."""
    sim, names = (np.concatenate(x, axis=1) for x in zip(a, b))
    order = np.lexsort((names, -sim), axis=1)[:, :k]
    return np.take_along_axis(sim, order, axis=1), np.take_along_axis(names, order, axis=1)


def vote(near: DataFrame, labels: DataFrame, keys: list[str] = ["q"], weighted: bool = True, ones_if_zero: bool = True) -> DataFrame:
    """(keys, code, weight, share): similarity-weighted votes of labels(ref, code).

    Negative similarities weigh 0; where all weigh 0, each counts 1 (ones_if_zero).
    """
    v = near.join(labels, "ref").withColumn("w", F.greatest(F.col("sim"), F.lit(0.0)) if weighted else F.lit(1.0))
    g = v.groupBy(*keys, "code").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    total = W.partitionBy(*keys)
    weight = F.when(F.sum("w").over(total) > 0, F.col("w")).otherwise(F.col("n").cast("double") if ones_if_zero else F.lit(0.0))
    g = g.withColumn("weight", weight)
    return g.select(*keys, "code", "weight", (F.col("weight") / F.greatest(F.sum("weight").over(total), F.lit(1e-9))).alias("share"))


def top_codes(votes: DataFrame, n: int, keys: list[str] = ["q"]) -> DataFrame:
    """The n codes of most votes, with rank."""
    w = W.partitionBy(*keys).orderBy(F.desc("weight"), "code")
    return votes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def predict(near: DataFrame, labels: DataFrame, queries: DataFrame, keys: list[str] = ["q"], **params) -> DataFrame:
    """(keys, code, share) of the winning code of every query; ('', 0) without candidates."""
    best = top_codes(vote(near, labels, keys, **params), 1, keys).select(*keys, "code", "share")
    return queries.select(*keys).distinct().join(best, keys, "left").na.fill({"code": "", "share": 0.0})


def distribution(votes: DataFrame, codes: DataFrame, keys: list[str] = ["q"]) -> DataFrame:
    """A row for each query and code of the dimension table, 0 where it got no vote."""
    q = votes.select(*keys).distinct()
    # codes is a dimension of a few dozen rows: the result has one row for each query and code.
    return q.crossJoin(F.broadcast(codes.select("code"))).join(votes.select(*keys, "code", "share"), [*keys, "code"], "left").na.fill(0.0, ["share"])


def fuse(a: DataFrame, b: DataFrame, keys: list[str] = ["q"]) -> DataFrame:
    """Mean of two distributions (keys, code, share)."""
    both = a.select(*keys, "code", "share").unionByName(b.select(*keys, "code", "share"))
    return both.groupBy(*keys, "code").agg((F.sum("share") / 2).alias("weight"))


def confidence(a: DataFrame, b: DataFrame, keys: list[str] = ["q"], n: int = 3) -> DataFrame:
    """Fused top n codes, and HIGH if both methods' best agree, MEDIUM if the second's best is among them, else LOW."""
    top = lambda d, name: top_codes(d.select(*keys, "code", F.col("share").alias("weight")), 1, keys).select(*keys, F.col("code").alias(name))
    fused = top_codes(fuse(a, b, keys), n, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes"))
    j = fused.join(top(a, "best_a"), keys).join(top(b, "best_b"), keys)
    tier = F.when(F.col("best_a") == F.col("best_b"), "HIGH").when(F.array_contains("codes", F.col("best_b")), "MEDIUM").otherwise("LOW")
    return j.select(*keys, "codes", tier.alias("confidence"))


def nearest(queries: DataFrame, refs: DataFrame, labels: DataFrame, pool: list[str] = []) -> DataFrame:
    """(pool, q, code) of the nearest definition; the smallest reference wins ties."""
    return neighbours(queries, refs, 1, pool=pool).join(labels, "ref").select(*pool, "q", "code")


def cascade(queries: DataFrame, refs: DataFrame, k: int = 15, fold: str | None = None) -> DataFrame:
    """Theme, then main class within it, then subgroup within that, and the flat subgroup.

    queries(q, embedding, fold); refs(ref, embedding, source_type, theme, main_class,
    subgroup_code, fold), examples and definitions. Every stage restricts the
    candidates by the stage before, an equi-join on the predicted parent; with
    fold, examples of the query's own fold are no candidates.
    """
    example = F.col("source_type") == "example"
    x = fold
    if x:
        refs = refs.withColumn(x, F.when(example, F.col(x).cast("string")).otherwise("-"))
    stage = lambda q, r, pool: neighbours(q, r, k, pool=pool, exclude=x)
    lab = lambda r, c: r.filter(F.col(c) != "").select("ref", F.col(c).alias("code"))
    theme = predict(stage(queries, refs, []), lab(refs, "theme"), queries).select("q", F.col("code").alias("pred_theme"), F.col("share").alias("theme_conf"))
    theme = materialize(theme, "themes")
    q2 = queries.join(theme, "q").withColumn("theme", F.col("pred_theme"))
    main_refs = refs.filter(F.col("main_class") != "")
    main = predict(stage(q2, main_refs, ["theme"]), lab(main_refs, "main_class"), q2).select("q", F.col("code").alias("pred_main"), F.col("share").alias("main_conf"))
    main = materialize(main, "main-classes")
    q3 = queries.join(main, "q").withColumn("main_class", F.col("pred_main"))
    sub_refs = refs.filter(F.col("subgroup_code") != "")
    sub = predict(stage(q3, sub_refs, ["main_class"]), lab(sub_refs, "subgroup_code"), q3).select("q", F.col("code").alias("pred_sub"), F.col("share").alias("sub_conf"))
    flat = predict(stage(queries, sub_refs, []), lab(sub_refs, "subgroup_code"), queries).select("q", F.col("code").alias("flat_sub"))
    return theme.join(main, "q").join(sub, "q").join(flat, "q")


def silhouette(df: DataFrame, key: str = "q", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Mean cosine silhouette, null with fewer than two labels or three rows; from the labels' vector sums, no pairs."""
    rows = df.select(F.col(key).alias("q"), F.col(label).alias("label"), unit(F.col(vector)).alias("v"))
    each = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"), F.max("n").alias("n"))  # a row a label
    pairs = rows.crossJoin(F.broadcast(sums.select(F.col("label").alias("other"), "s", "n")))  # rows x labels
    d = pairs.withColumn("d", F.lit(1.0) - dot(F.col("v"), F.col("s")) / F.col("n"))
    own = F.max(F.when(F.col("label") == F.col("other"), F.struct("d", "n")))
    g = d.groupBy("q", "label").agg(own.alias("own"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    # d counts the row itself at distance 0 (a unit vector's), which the mean over the others leaves out.
    a = F.col("own.d") * F.col("own.n") / (F.col("own.n") - 1)
    s = F.when(F.col("own.n") > 1, (F.col("b") - a) / F.greatest(a, F.col("b"))).otherwise(0.0)
    return g.withColumn("s", s).agg(F.count("*").cast("long").alias("n"), F.when((F.count("*") >= 3) & (F.count_distinct("label") >= 2), F.avg("s")).alias("silhouette"))
