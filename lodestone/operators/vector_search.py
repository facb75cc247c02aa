"""Vector search: exact top-k for one query, blocked nearest neighbours for many, an index of cells, and densities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import METRICS, as_vector, cosine

EPS = 1e-12


def top_k(df: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", vector: str = "embedding", tie: str = "vec_id", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """The k rows nearest to one query vector, with ``score``; rows are filtered before the top-k.

    Spark takes the top k of each partition and merges them, so only k rows of
    each partition are moved.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    found = df if where is None else df.where(where)
    found = found.withColumn("score", METRICS[metric](F.col(vector), as_vector(query)))
    if threshold is not None:
        found = found.where(F.col("score") >= threshold)
    return found.orderBy(F.desc("score"), tie).limit(k)


def post_filtered(df: DataFrame, query: list[float], k: int, where: Column | None = None, threshold: float | None = None, near_dup_delta: float | None = None, **options: str) -> DataFrame:
    """Top-k first, then threshold, near-duplicate and other filters: it may return fewer than k rows."""
    found = top_k(df, query, k, **options)
    if threshold is not None:
        found = found.where(F.col("score") >= threshold)
    if near_dup_delta is not None:
        found = found.where(1 - F.col("score") > near_dup_delta)
    return found if where is None else found.where(where)


def sharded_top_k(df: DataFrame, query: list[float], k: int, shard: Column, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """Top k of each shard, then of all: the same rows as ``top_k``, with the shard and the rank in it."""
    scored = df.withColumn("score", cosine(F.col(vector), as_vector(query))).withColumn("shard", shard)
    best = Window.partitionBy("shard").orderBy(F.desc("score"), tie)
    return scored.withColumn("shard_rank", F.row_number().over(best)).where(F.col("shard_rank") <= k).orderBy(F.desc("score"), tie).limit(k)


#: Blocks of a side: as many as it has BLOCK_ROWS, at most MOST_BLOCKS, beyond which blocks grow up to LARGEST_BLOCK rows before there are more.
BLOCK_ROWS, MOST_BLOCKS, LARGEST_BLOCK = 2000, 12, 1 << 16
#: Rows of queries that meet a block at once, rows of the block in one product of theirs, and rows of which only the best counts at first.
STRIP_ROWS, TILE_ROWS, SPAN = 256, 1024, 64
#: Meetings in strips are so many tasks at most.
MOST_TASKS = 1024


def _margin(dims: int) -> float:
    """How far a cosine in single precision may be off; what lies nearer to a bound is judged in doubles."""
    return (dims + 8) * 2.0**-23


def block_count(rows: int, block_rows: int) -> int:
    """Into how many blocks a side of so many rows is dealt."""
    return max(1, min(-(-rows // block_rows), MOST_BLOCKS), -(-rows // max(LARGEST_BLOCK, block_rows)))


def _dealt_by_range(df: DataFrame, by: str, blocks: int, rows: int) -> tuple[DataFrame, list[tuple[float, float]]]:
    """The rows with their ``block``, and the least and greatest value of ``by`` in each block.

    Blocks are ranges of values, so that equal values share one. A value of more
    rows than a block should have is a range of its own; a range of too many
    rows is several blocks, dealt by hash.
    """
    cuts = df.agg(F.percentile_approx(by, [i / blocks for i in range(1, blocks)], max(10_000, 100 * blocks))).first()[0] if blocks > 1 else None
    cuts = cuts or []
    passed = lambda values, holds: F.size(F.filter(F.array(*(F.lit(c) for c in values)), holds)) if values else F.lit(0)
    frequent = sorted({c for c, d in zip(cuts, cuts[1:], strict=False) if c == d})
    found = passed(sorted(set(cuts)), lambda c: c < F.col(by)) + passed(frequent, lambda c: c <= F.col(by))
    # At most one row for each block.
    ranges = df.groupBy(found.alias("range")).agg(F.count("*").alias("n"), F.min(by).alias("low"), F.max(by).alias("high")).orderBy("range").collect()
    firsts, parts, spans = {}, {}, []
    for r in ranges:
        firsts[r["range"]], parts[r["range"]] = len(spans), max(1, round(r["n"] * blocks / rows))
        spans += [(r["low"], r["high"])] * parts[r["range"]]
    count = max(firsts, default=0) + 1
    at = lambda values: F.element_at(F.array(*(F.lit(values.get(i, 1)) for i in range(count))), F.col("range") + 1)
    return df.withColumn("range", found).withColumn("block", at(firsts) + F.pmod(F.xxhash64("id"), at(parts)).cast("int")).drop("range"), spans


def meet_blocks(queries: DataFrame, corpus: DataFrame, vector: str, id_col: str, extra: list[tuple[str, Column]], block_rows: int, meet, schema: str, in_strips: bool = False, by: str | None = None, above: bool = False) -> DataFrame:  # noqa: ANN001
    """Deal both sides into blocks of about ``block_rows`` rows and let every two blocks meet, ``in_strips`` in a task of their own or in one of MOST_TASKS.

    Rows without a vector take no part. Every row is copied once for each block
    of the other side. Meetings that work ``in_strips`` take larger blocks, so
    that their shuffle grows with the rows up to MOST_BLOCKS blocks of
    LARGEST_BLOCK rows; beyond that, and for others, it grows with rows times
    blocks. The comparisons are quadratic.

    With ``by``, a number among ``extra``, a corpus row counts only where its
    value is below (or ``above``) the query's: blocks are ranges of it, two
    blocks without any such pair don't meet, and rows without a value take no part.
    """
    sides = []
    for df in (queries, corpus)[: 1 if queries is corpus else 2]:
        df = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), *(c.alias(n) for n, c in extra))
        if by:
            df = df.where(F.col(by).isNotNull() & ~F.isnan(by))
        n = df.count()
        blocks = block_count(n, block_rows) if in_strips else max(1, -(-n // block_rows))
        sides.append(_dealt_by_range(df, by, blocks, n) if by else (df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), [(0.0, 0.0)] * blocks))
    (left, of_left), (right, of_right) = sides[0], sides[-1]
    allowed = (lambda q, c: c[1] > q[0] if above else c[0] < q[1]) if by else lambda q, c: True
    # The blocks that a block meets are neighbours in the order of ranges, on both sides: (first, last), or (0, -1) for none.
    theirs = [[j for j, c in enumerate(of_right) if allowed(q, c)] for q in of_left]
    ours = [[i for i, q in enumerate(of_left) if allowed(q, c)] for c in of_right]
    meetings = sum(map(len, theirs))
    # Meeting number of blocks i and j: shift[i] + j, without gaps.
    shift, number = [], 0
    for met in theirs:
        shift.append(number - (met[0] if met else 0))
        number += len(met)
    of = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values or [0])), at + 1)
    first, last = (lambda blocks: [x[0] if x else 0 for x in blocks]), (lambda blocks: [x[-1] if x else -1 for x in blocks])
    block, columns = F.col("block"), ["id", "v", *(n for n, _ in extra)]

    def copied(side: DataFrame, met: list[list[int]], meeting) -> DataFrame:  # noqa: ANN001
        some = of(first(met), block) <= of(last(met), block)
        return side.select(F.explode(F.when(some, F.transform(F.sequence(of(first(met), block), of(last(met), block)), meeting))).alias("meeting"), *(F.col(c).alias(c) for c in columns))  # named again, as both sides may be one table

    left, right = copied(left, theirs, lambda j: of(shift, block) + j), copied(right, ours, lambda i: of(shift, i) + block)
    if in_strips:
        # Dealt by number: hashes of so few keys would leave some tasks empty and others with several meetings.
        left, right = (x.repartitionById(max(1, min(meetings, MOST_TASKS)), "meeting") for x in (left, right))
    return left.groupBy("meeting").cogroup(right.groupBy("meeting")).applyInPandas(meet, schema)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)


def _matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    return unit_rows(vectors) if metric == "cosine" else np.stack(vectors.to_numpy()).astype(np.float64)


def _least_copies(x: np.ndarray, g: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows that can be among k nearest: of equal vectors of a group those with the k smallest ids."""
    order = np.lexsort((ids, g))
    keys = np.ascontiguousarray(np.column_stack([x, g])[order] + 0.0).view(np.dtype((np.void, 8 * (x.shape[1] + 1)))).ravel()
    kind = np.unique(keys, return_inverse=True)[1].ravel()
    by = np.argsort(kind, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(kind[by])) + 1]
    place = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    return np.sort(order[by[place < k]])


def _nearest(q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, upto: np.ndarray, same: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, distance) of the k nearest of c's first ``upto`` rows to each row of q, without the pairs in ``same``.

    A strip of queries meets c in tiles that stay in the cache, in single
    precision (in double for other metrics than cosine), a column for each
    query. The k-th best of the spans' best bounds the k-th best of all, so
    only pairs beyond it are scored in doubles.
    """
    kind = np.float32 if metric == "cosine" else np.float64
    a = q.astype(kind)
    padded = -(-len(c) // SPAN) * SPAN
    flat = np.zeros((padded, c.shape[1]), kind)
    flat[: len(c)] = c if metric == "cosine" else 2 * c
    margin = _margin(c.shape[1])
    if metric != "cosine":
        lift = np.zeros((padded, 1))
        lift[: len(c), 0] = (c * c).sum(1)
        margin = 1e-12 * (1 + lift.max(initial=0) + (q * q).sum(1).max(initial=0)) * c.shape[1]
    rows, columns, found = [], [], []
    same = same[np.argsort(same[:, 0], kind="stable")]
    scores, bests = np.empty(padded * STRIP_ROWS, kind), np.empty(padded // SPAN * STRIP_ROWS, kind)
    for at in range(0, len(q), STRIP_ROWS):
        reach = upto[at : at + STRIP_ROWS]
        width, wide = int(reach.max(initial=0)), len(reach)
        if not width:
            continue
        n_spans = -(-width // SPAN)
        s, best = scores[: n_spans * SPAN * wide].reshape(-1, wide), bests[: n_spans * wide].reshape(-1, wide)
        spans, asked, least = s.reshape(n_spans, SPAN, wide), np.ascontiguousarray(a[at : at + wide].T), int(reach.min())
        for low in range(0, len(s), TILE_ROWS):
            tile = s[low : low + TILE_ROWS]
            high = low + len(tile)
            np.matmul(flat[low:high], asked, out=tile)
            if metric != "cosine":
                tile -= lift[low:high]
            if high > least:
                tile[np.arange(low, high)[:, None] >= reach[None]] = -np.inf
            np.max(spans[low // SPAN : high // SPAN], axis=1, out=best[low // SPAN : high // SPAN])
        own = same[np.searchsorted(same[:, 0], at) : np.searchsorted(same[:, 0], at + wide)]
        own_row, own_span = own[:, 0] - at, own[:, 1] // SPAN
        s[own[:, 1], own_row] = -np.inf
        best[own_span, own_row] = spans[own_span, :, own_row].max(axis=1)
        # With fewer spans than k there is no bound, and all allowed pairs are scored.
        bound = np.partition(best, n_spans - k, axis=0)[n_spans - k] - margin if n_spans >= k else np.full(wide, -np.inf, kind)
        b, r = np.nonzero((best >= bound) & (best > -np.inf))
        for part in range(0, len(r), 4096):
            pr, pb = r[part : part + 4096], b[part : part + 4096]
            near = spans[pb, :, pr]
            x, y = np.nonzero((near >= bound[pr][:, None]) & (near > -np.inf))
            qi, ci = pr[x] + at, pb[x] * SPAN + y
            if metric == "cosine":
                d = 1 - np.clip(np.einsum("ij,ij->i", q[qi], c[ci]), -1, 1)
            else:
                d = np.sqrt(((q[qi] - c[ci]) ** 2).sum(1))
            rows.append(qi), columns.append(ci), found.append(d)
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    qi, ci, d = np.concatenate(rows), np.concatenate(columns), np.concatenate(found)
    order = np.lexsort((c_ids[ci], d, qi))
    qi, ci, d = qi[order], ci[order], d[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1] if len(qi) else np.zeros(0, np.int64)
    place = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    return qi[place < k], ci[place < k], d[place < k]


def neighbours(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", vector: str = "embedding", id_col: str = "vec_id", exclude_self: bool = True, before: str | None = None, block_rows: int = BLOCK_ROWS, per: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of ``corpus`` for every row of ``queries`` that has a vector.

    Both sides are dealt into blocks that meet as matrices, and each meeting
    keeps its k best for a query; so a task holds two blocks whatever the
    tables' sizes. With ``before`` a corpus row counts only where its value of
    that column is below the query's. With ``per`` it counts only where its
    value is above the query's, and there are k for each of these values, in a
    column of that name. With either, blocks are ranges of these values, so
    that only blocks with such pairs meet and few blocks tell of one value. Where the quadratic work is too much, ``CellIndex``
    gives nearly the same neighbours.
    """
    by = before or per
    group = (F.col(by) if by else F.lit(0)).cast("double")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if by:
            c = c[c.g.notna()]
        if len(q) and len(c):
            qx, cx = _matrix(q.v, metric), _matrix(c.v, metric)
            sound = [np.isfinite(x).all(axis=1) for x in (qx, cx)]
            q, qx, c, cx = q[sound[0]].reset_index(drop=True), qx[sound[0]], c[sound[1]].reset_index(drop=True), cx[sound[1]]
        if len(q) and len(c):
            ids = np.unique(c.id.to_numpy(), return_inverse=True)[1].ravel()
            kept = _least_copies(cx, c.g.to_numpy(), ids, k + int(np.bincount(ids).max()) * exclude_self)
            c, cx, ids = c.iloc[kept].reset_index(drop=True), cx[kept], ids[kept]
            order = np.lexsort((ids, c.g.to_numpy()))
            c, cx, ids = c.iloc[order].reset_index(drop=True), cx[order], ids[order]
            order = np.argsort(q.g.to_numpy(), kind="stable")
            q, qx = q.iloc[order].reset_index(drop=True), qx[order]
            qg, cg = q.g.to_numpy(), c.g.to_numpy()
            same = np.zeros((0, 2), np.int64)
            if exclude_self:
                places = [pd.DataFrame({"id": x.id, n: np.arange(len(x))}) for n, x in (("a", q), ("b", c))]
                same = places[0].merge(places[1], on="id")[["a", "b"]].to_numpy(np.int64)
            known = int((~np.isnan(qg)).sum())
            if per:
                for g in np.unique(cg):
                    low, high, asked = np.searchsorted(cg, g, "left"), np.searchsorted(cg, g, "right"), np.searchsorted(qg[:known], g, "left")
                    here = same[(same[:, 0] < asked) & (same[:, 1] >= low) & (same[:, 1] < high)] - [0, low]
                    a, b, d = _nearest(qx[:asked], cx[low:high], ids[low:high], np.full(asked, high - low), here, k, metric)
                    out.append(pd.DataFrame({"query_id": q.id.to_numpy()[a], "id": c.id.to_numpy()[b + low], "distance": d, "g": g}))
            else:
                upto = np.where(np.arange(len(q)) < known, np.searchsorted(cg, qg, "left"), 0) if before else np.full(len(q), len(c))
                a, b, d = _nearest(qx, cx, ids, upto, same[same[:, 1] < upto[same[:, 0]]], k, metric)
                out.append(pd.DataFrame({"query_id": q.id.to_numpy()[a], "id": c.id.to_numpy()[b], "distance": d, "g": 0.0}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "distance": [], "g": []})

    kind = queries.schema[id_col].dataType.simpleString()
    met = meet_blocks(queries, corpus, vector, id_col, [("g", group)], block_rows, meet, f"query_id {kind}, id {kind}, distance double, g double", in_strips=True, by="g" if by else None, above=bool(per))
    nearest = Window.partitionBy("query_id", "g").orderBy("distance", "id") if per else Window.partitionBy("query_id").orderBy("distance", "id")
    best = met.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return best.withColumn(per, F.col("g").cast(corpus.schema[per].dataType)).drop("g") if per else best.drop("g")


def similar_counts(df: DataFrame, threshold: float, vector: str = "embedding", id_col: str = "vec_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, class_id, n_links) of every row: a similarity join on cosine, told by counts.

    Rows with the same vector are one class, named by its smallest id; only
    classes meet. n_links is the number of other rows whose cosine is at least
    the threshold. A row without a vector is a class of its own without links.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"class_id": [], "n": []})
        x, y, copies = unit_rows(q.v), unit_rows(c.v), c.copies.to_numpy()
        a, flat, many, margin = x.astype(np.float32), y.astype(np.float32), np.flatnonzero(copies > 1), np.float32(_margin(x.shape[1]))
        places = pd.DataFrame({"id": q.id, "a": np.arange(len(q))}).merge(pd.DataFrame({"id": c.id, "b": np.arange(len(c))}), on="id")
        own = places.sort_values("a")[["a", "b"]].to_numpy(np.int64)
        n = np.zeros(len(q), np.int64)
        np.add.at(n, own[:, 0], copies[own[:, 1]])  # copies link however the threshold rounds
        for at in range(0, len(q), STRIP_ROWS):
            asked = a[at : at + STRIP_ROWS]
            here = own[np.searchsorted(own[:, 0], at) : np.searchsorted(own[:, 0], at + len(asked))] - [at, 0]
            for low in range(0, len(flat), TILE_ROWS):
                s = asked @ flat[low : low + TILE_ROWS].T
                inside = here[(here[:, 1] >= low) & (here[:, 1] < low + s.shape[1])]
                s[inside[:, 0], inside[:, 1] - low] = np.nan
                linked, open_ = s > np.float32(threshold) + margin, s >= np.float32(threshold) - margin
                open_ ^= linked
                # Cosines that single precision can't tell from the threshold are judged in doubles.
                for i in np.flatnonzero(open_.any(axis=1)):
                    j = np.flatnonzero(open_[i])
                    linked[i, j] = np.clip(y[low + j] @ x[at + i], -1, 1) >= threshold
                n[at : at + len(s)] += [np.count_nonzero(row) for row in linked]
                of = many[np.searchsorted(many, low) : np.searchsorted(many, low + s.shape[1])]
                if len(of):
                    n[at : at + len(s)] += linked[:, of - low] @ (copies[of] - 1)
        return pd.DataFrame({"class_id": q.id, "n": n})

    kind = rows.schema["id"].dataType.simpleString()
    counts = meet_blocks(classes, classes, "v", "class_id", [("copies", F.col("copies"))], block_rows, meet, f"class_id {kind}, n long", in_strips=True).groupBy("class_id").agg((F.sum("n") - 1).alias("n_links"))
    known = rows.join(classes.select("v", "class_id"), "v", "left").join(counts, "class_id", "left")
    return known.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def density(queries: DataFrame, corpus: DataFrame, k: int = 5, kind: str = "average", eps: float = EPS, **options: object) -> DataFrame:
    """(query_id, density): 1 / (eps + mean distance) of the k nearest, or k / (eps + distance of the k-th).

    A query without a vector has a null density; one without any neighbour has no row.
    """
    near = neighbours(queries, corpus, k, **options).groupBy("query_id").agg(F.avg("distance").alias("mean"), F.max("distance").alias("radius"), F.count("*").alias("n"))
    value = 1 / (eps + F.col("mean")) if kind == "average" else F.col("n") / (eps + F.col("radius"))
    return near.select("query_id", value.alias("density")).unionByName(_without_vector(queries, options).withColumn("density", F.lit(None).cast("double")))


def _without_vector(queries: DataFrame, options: dict) -> DataFrame:
    return queries.where(F.col(options.get("vector", "embedding")).isNull()).select(F.col(options.get("id_col", "vec_id")).alias("query_id"))


def novelty(df: DataFrame, group: str, k: int = 5, eps: float = EPS, id_col: str = "vec_id", **options: object) -> DataFrame:
    """(group, novelty): 1 / (eps + mean density of a group's vectors among all earlier groups); 0 without history."""
    found = density(df, df, k, before=group, id_col=id_col, **options).join(df.select(F.col(id_col).alias("query_id"), group), "query_id", "right")
    mean = F.avg(F.coalesce("density", F.lit(0.0)))
    return found.groupBy(group).agg(F.when(F.count("density") == 0, F.lit(0.0)).otherwise(1 / (eps + mean)).alias("novelty"))


def forward_density(df: DataFrame, group: str, k: int = 5, eps: float = EPS, id_col: str = "vec_id", **options: object) -> DataFrame:
    """(group, forward): the mean density of all earlier groups' vectors among a group's own; 0 for the first group.

    All groups are compared in one pass over the blocks: each vector keeps its k
    nearest of every later group. An earlier row without a vector counts as 0.
    """
    vector = options.get("vector", "embedding")
    # One row for each group.
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg((F.count("*") - F.count(vector)).alias("bare"))
    groups = sizes.select(group, F.row_number().over(Window.orderBy(group)).alias("place_"), (F.sum("bare").over(Window.orderBy(group)) - F.col("bare")).alias("bare_before"))
    rows = df.join(groups.select(group, "place_"), group).select(id_col, vector, "place_")
    near = neighbours(rows, rows, k, id_col=id_col, per="place_", **options).groupBy("place_", "query_id").agg((1 / (eps + F.avg("distance"))).alias("density"))
    sums = near.groupBy("place_").agg(F.sum("density").alias("sum"), F.count("*").alias("n"))
    mean = F.col("sum") / (F.col("n") + F.col("bare_before"))
    return groups.join(sums, "place_", "left").select(group, F.coalesce(mean, F.lit(0.0)).alias("forward"))


def exploration_reward(df: DataFrame, group: str, k: int = 5, weights: tuple[float, float] = (0.5, 0.5), **options: object) -> DataFrame:
    """(group, novelty, forward, reward): how new a group's vectors are against all earlier ones, how close the earlier ones are to it, and their weighted sum."""
    both = novelty(df, group, k, **options).join(forward_density(df, group, k, **options), group)
    return both.withColumn("reward", weights[0] * F.col("novelty") + weights[1] * F.col("forward"))


def least_distance(queries: DataFrame, library: DataFrame, **options: object) -> DataFrame:
    """(query_id, id, distance): the nearest library vector of each query, nulls for a query without a vector."""
    found = neighbours(queries, library, 1, **options).select("query_id", "id", "distance")
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("id", "distance")]
    return found.unionByName(_without_vector(queries, options).select("query_id", *none))


class CellIndex:
    """An index of cells around centres, with a short code of every row, that grows with the table.

    There are as many cells as the square root of the rows, at most MOST_CELLS,
    and every row with a vector lies in the cell of its nearest centre. Its code
    has one byte for each dimension: where it lies from that centre. A query
    scores the codes of the rows in its nearest cells, and only the best RERANK
    times k of these are scored again by their vectors.

    The centres are fitted by spherical k-means on the rows of the lowest id
    hashes, SAMPLE_ROWS or 32 for each cell; how many cells a query probes is
    fitted there too: so many that they hold 0.96 of the sample's own nearest
    neighbours. Vectors without any structure need most cells, clustered ones a
    few, and so the share of rows that a query reads falls as the table grows.
    ``write`` stores codes and vectors by cell, and a search opens the cells
    that it probes.
    """

    SAMPLE_ROWS = 20_000
    MOST_CELLS = 4096
    RERANK = 4
    ENOUGH = 0.96

    def __init__(self, df: DataFrame, cells: int | None = None, probes: int | None = None, rounds: int = 10, vector: str = "embedding", id_col: str = "vec_id"):
        self.vector, self.id_col = vector, id_col
        rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<float>").alias("v"))
        self.n = rows.count()
        wanted = cells or max(1, min(self.MOST_CELLS, int(self.n**0.5)))
        hashed = rows.select("v", F.shiftrightunsigned(F.xxhash64("id"), 11).alias("h"))
        sample = np.array([r[0] for r in hashed.orderBy("h").limit(max(self.SAMPLE_ROWS, 32 * wanted)).collect()], float)
        unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), EPS) if len(sample) else np.zeros((0, 0))
        self.centres = self._fit(unit, wanted, rounds)
        spread = np.abs(unit - self.centres[(unit @ self.centres.T).argmax(1)]).max() if len(unit) else 0.0
        #: The length of one step of a code; a row further out than any of the sample has its code cut there, which only its first score feels.
        self.step = max(float(spread), EPS) * 1.25 / 127
        self.probes = min(len(self.centres), probes or self._probes(unit))
        self.rows = self._coded(rows)

    @staticmethod
    def _fit(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
        if not len(x):
            return np.zeros((0, 0))
        centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            empty = np.bincount(own, minlength=len(centres)) == 0
            sums[empty] = centres[empty]
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), EPS)
        return centres

    def _probes(self, x: np.ndarray, k: int = 10, asked: int = 512) -> int:
        """How many nearest cells hold ENOUGH of the nearest neighbours that rows of the sample have in it."""
        if len(x) < 2:
            return 1
        own = (x @ self.centres.T).argmax(1)
        some = np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)
        near = x[some] @ x.T
        near[np.arange(len(some)), some] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(x[some] @ self.centres.T), axis=1, kind="stable"), axis=1)
        ranks = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, int(self.ENOUGH * len(ranks)))]) + 1

    def _coded(self, df: DataFrame) -> DataFrame:
        """(id, v, cell, code)"""
        centres, step = self.centres, self.step

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    unit = unit_rows(b.v)
                    cell = (unit @ centres.T).argmax(1)
                    code = np.clip(np.rint((unit - centres[cell]) / step), -127, 127).astype(np.int8)
                    yield b.assign(cell=cell.astype(np.int32), code=[x.tobytes() for x in code])

        return df.mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, v array<float>, cell int, code binary")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(id, v, cell): each query with each cell that it probes."""
        centres, n = self.centres, self.probes
        df = queries.where(F.col(self.vector).isNotNull()).select(F.col(self.id_col).alias("id"), F.col(self.vector).cast("array<float>").alias("v"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                near = np.argsort(-(unit_rows(b.v) @ centres.T), axis=1, kind="stable")[:, :n] if len(b) and len(centres) else np.zeros((len(b), 0), int)
                yield b.assign(cells=list(near.astype(np.int32)))

        found = df.mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, v array<float>, cells array<int>")
        return found.select("id", "v", F.explode("cells").alias("cell"))

    def write(self, path: str) -> CellIndex:
        """Store codes and vectors by cell and search them there from now on."""
        self.rows.write.mode("errorifexists").partitionBy("cell").parquet(path)
        self.rows = self.rows.sparkSession.read.schema(self.rows.schema).parquet(path)
        return self

    def share_read(self, queries: DataFrame) -> float:
        """The mean share of all rows whose codes a query reads."""
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("n"))
        found = self._asked(queries).join(sizes, "cell").agg(F.sum("n").alias("read"), F.count_distinct("id").alias("queries")).first()
        return found["read"] / (found["queries"] * self.n) if found["queries"] and self.n else 0.0

    def search(self, queries: DataFrame, k: int, block_rows: int = 2000) -> DataFrame:
        """(query_id, id, score, rank): the k best rows of the probed cells for each query, itself left out.

        Queries and codes meet by cell and by blocks of rows within it, so that a large cell is many tasks.
        """
        asked = self._asked(queries)
        # At most as many values as there are cells.
        probed = [r[0] for r in asked.select("cell").distinct().collect()]
        held = self.rows.where(F.col("cell").isin(probed))
        blocks = max(1, -(-self.n // (block_rows * max(1, len(self.centres)))))
        left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = held.select("id", "cell", "code", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        centres, step, width = self.centres, self.step, self.RERANK * k

        def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": [], "id": [], "about": [], "cell": []}
            if len(q) and len(c):
                cell = int(c.cell.iloc[0])
                codes = np.frombuffer(b"".join(c.code), np.int8).reshape(len(c), -1)
                there = centres[cell] + codes * step
                scores = unit_rows(q.v) @ (there / np.maximum(np.linalg.norm(there, axis=1, keepdims=True), EPS)).T
                scores[q.id.to_numpy()[:, None] == c.id.to_numpy()[None]] = -np.inf
                ids = c.id.to_numpy()
                for row in range(len(q)):
                    best = np.argpartition(-scores[row], min(width, len(ids)) - 1)[:width]
                    best = best[np.isfinite(scores[row, best])]
                    out["query_id"] += [q.id.iloc[row]] * len(best)
                    out["id"] += ids[best].tolist()
                    out["about"] += scores[row, best].tolist()
                    out["cell"] += [cell] * len(best)
            return pd.DataFrame(out)

        kind = asked.schema["id"].dataType.simpleString()
        met = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(meet, f"query_id {kind}, id {kind}, about double, cell int")
        first = Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
        chosen = met.withColumn("nth_", F.row_number().over(first)).where(F.col("nth_") <= width).select("query_id", "id", "cell")
        vectors = held.select(F.col("id").alias("row_id"), F.col("cell").alias("row_cell"), F.col("v").alias("row_v"))
        own = queries.select(F.col(self.id_col).alias("own_id"), F.col(self.vector).alias("own_v"))
        both = chosen.join(vectors, (F.col("id") == F.col("row_id")) & (F.col("cell") == F.col("row_cell"))).join(own, F.col("query_id") == F.col("own_id"))
        scored = both.select("query_id", "id", cosine(F.col("own_v"), F.col("row_v")).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rerank(docs: DataFrame, query: list[float] | None, top_n: int, vector: str = "embedding", position: str = "pos") -> DataFrame:
    """Documents by cosine to the query; without a query vector scores fall by 0.1 for each position."""
    score = cosine(F.col(vector), as_vector(query)) if query else 1.0 - 0.1 * F.col(position)
    return docs.withColumn("score", score).orderBy(F.desc("score"), position).limit(top_n)
