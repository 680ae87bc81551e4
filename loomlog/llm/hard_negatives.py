r"""Hard negatives by inverted lists of k-means clusters, exact.

Each component x of a vector becomes floor(scale * x); scores are integer inner products.  A
bounded sample gives the centroids (``sample_rows``, ``most_lists``); every row then goes to the list of its
nearest centroid, and each list has the radius r of its members.  By Cauchy-Schwarz the score of an
anchor q with any member lies within |q| r of its product with the centroid c.

An anchor looks for the best rows within a window of scores: its positives among rows of its label
without limits, then for each positive the negatives whose scores lie between two shares of the positive's.  It visits
lists by their upper bound, skips those that lie outside of the window, and stops when the bound falls
strictly below its kth score (a tie may still win by its id).  The first visit is to the lists with the best
bounds alone; the kth scores found there keep most other lists from being visited at all.  The lists only save
work: whatever the centroids, the result is that of comparing all pairs.

Lists lie on shelves of at most ``shelf_rows`` rows; a longer list is dealt over several.  Anchors
are dealt in blocks of the same size.  A task gets one shelf with one block, so no task grows with the
table, with a list of very many equal vectors, or with the number of anchors; a list that no anchor of a block
visits is not sent.

Rows with a null label, a null vector, or a null or non-finite component take no part.  Shorter
vectors count as padded with zeros; empty vectors score 0.  Rows that repeat a vec_id are separate rows, each an
anchor if the id makes it one.  A null vec_id is never an anchor's by the default rule and comes after all others
among equal scores.  Scores beyond 64 bits are held at the limit.  An empty table, or one without anchors, gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.cluster import checkpointed, small_batches, stored

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_CELLS = 1 << 21  # scores held at once
_MOST_BROADCAST = 200_000
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
_FOUND = "query bigint, slot int, score bigint, vec_id bigint, row bigint"


def _matrix(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """Scaled vectors as rows, padded with zeros; extended precision where doubles might round a score."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices in a type in which their products are exact."""
    most = max(1, a.shape[1]) * max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0))
    return (a, b) if most < 1 << 53 else (a.astype(np.longdouble), b.astype(np.longdouble))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(axis=1) / 2
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, _CELLS // len(centroids))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.argmax(x[lo : lo + step] @ centroids.T - half, axis=1)
    return out


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds over the sample; centroids without members go."""
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        of = _nearest(x, centroids)
        n = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        centroids = sums[n > 0] / n[n > 0, None]
    return centroids


class Index:
    """Centroids with radii, and the shelves on which their lists lie."""

    def __init__(self, centroids: np.ndarray, sizes: dict[int, int], radii: dict[int, float], scale: float, shelf_rows: int):
        self.centroids, self.scale = centroids, scale
        n = len(centroids)
        self.norms = np.linalg.norm(centroids, axis=1)
        self.radii = np.array([radii.get(k, 0.0) for k in range(n)])
        self.used = np.array([k in sizes for k in range(n)])
        self.parts = np.array([max(1, -(-sizes.get(k, 0) // shelf_rows)) for k in range(n)])
        self.first = np.zeros(n, dtype=np.int64)
        # Along the direction in which the centroids differ most, so that neighbours share a shelf.
        spread = centroids - centroids.mean(axis=0)
        along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0] if n > 1 and centroids.shape[1] else np.zeros(n)
        shelf, held = 0, 0
        for k in np.argsort(along, kind="stable"):
            size = sizes.get(k, 0)
            if self.parts[k] > 1 or held + size > shelf_rows:
                shelf, held = shelf + bool(held), 0
            self.first[k], held = shelf, held + size
            if self.parts[k] > 1:
                shelf, held = shelf + int(self.parts[k]), 0
        self.shelves = shelf + 1

    def bounds(self, q: np.ndarray, lists: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products with the centroids, and bounds below and above the scores of their lists."""
        c, norms, radii = (x if lists is None else x[lists] for x in (self.centroids, self.norms, self.radii))
        length = np.linalg.norm(q, axis=1)[:, None]
        mid = q @ c.T
        reach = length * radii + 1e-9 * length * (norms + radii) + 1e-6  # what rounding may take away
        return mid, mid - reach, mid + reach


def _limits(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Ends of the windows of each anchor's slots; the ends of the range of 64 bits stand for none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = np.where(flat == _LEAST, -np.inf, np.where(flat == _MOST, np.inf, flat.astype(kind)))
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), int(sizes.max(initial=0))), np.nan, dtype=kind)  # slots that an anchor does not have
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _wanted(index: Index, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For anchor, slot and list: whether the list may hold scores of the window, and how good its bound is."""
    mid, below, above = index.bounds(q)
    may = index.used & (below[:, None, :] <= hi[:, :, None]) & (above[:, None, :] >= lo[:, :, None])
    bound = np.minimum(above[:, None, :], hi[:, :, None])
    # Of lists that all reach over the window's upper end, the one whose middle is nearest to it.
    far = np.where(np.isfinite(hi[:, :, None]), np.abs(mid[:, None, :] - hi[:, :, None]), 0)
    return may, np.where(may, bound - 1e-6 * far, -np.inf)


def _route(index: Index, dims: int, first: bool) -> Callable:
    """Adds the shelves that an anchor visits: those of the best list of each slot, or all others it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                q = _matrix(own.column("embedding"), dims, index.scale)
                may, good = _wanted(index, q, _limits(own.column("lo0")), _limits(own.column("hi")))
                best = np.argmax(good, axis=2) if good.shape[1] else np.zeros((len(q), 0), dtype=np.int64)
                seen = np.zeros((len(q), len(index.first)), dtype=bool)
                row, slot = np.nonzero(may.any(axis=2))
                seen[row, best[row, slot]] = True
                if not first:
                    open_ = _wanted(index, q, _limits(own.column("lo")), _limits(own.column("hi")))[0].any(axis=1)
                    seen = _shelf_mask(index, open_) & ~_shelf_mask(index, seen)
                else:
                    seen = _shelf_mask(index, seen)
                shelves = [np.flatnonzero(x).astype(np.int32) for x in seen]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(shelves, pa.list_(pa.int32()))], names=[*own.schema.names, "shelves"])

    return run


def _shelf_mask(index: Index, lists: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lists), index.shelves), dtype=bool)
    row, k = np.nonzero(lists)
    parts = index.parts[k]
    shelf = np.repeat(index.first[k], parts) + np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    out[np.repeat(row, parts), shelf] = True
    return out


def _top(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score, then column; scores of -inf where there are fewer."""
    n, m = scores.shape
    scores = np.where(valid, scores, -np.inf)
    if m > k:
        valid &= scores >= np.partition(scores, m - k, axis=1)[:, m - k, None]
    row, col = np.nonzero(valid)
    s = scores[row, col]
    order = np.lexsort((col, -s, row))
    row, col, s = row[order], col[order], s[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    best, at = np.full((n, k), -np.inf, dtype=scores.dtype), np.zeros((n, k), dtype=np.int64)
    best[row[keep], nth[keep]], at[row[keep], nth[keep]] = s[keep], col[keep]
    return best, at


def _visit(index: Index, dims: int, same: bool, k: int) -> Callable:
    """The k best rows of a shelf for each anchor and slot of a block."""

    def run(shelf: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {n: [] for n in ("query", "slot", "score", "vec_id", "row")}
        if shelf.num_rows and anchors.num_rows:
            search(shelf, anchors, out)
        kinds = {"slot": pa.int32()}
        return pa.table({n: pa.array(np.concatenate(v) if v and n != "vec_id" else [y for x in v for y in x], kinds.get(n, pa.int64())) for n, v in out.items()})

    def search(shelf: pa.Table, anchors: pa.Table, out: dict) -> None:
        ids = shelf["vec_id"].combine_chunks()
        no_id = np.array(ids.is_null())
        id_ = ids.fill_null(0).to_numpy()
        # Within the shelf the column is the order of ids, so that it decides between equal scores.
        order = np.lexsort((shelf["rid"].to_numpy(), id_, no_id))
        shelf = shelf.take(pa.array(order))
        lists, label, rid = (shelf[n].to_numpy() for n in ("list", "label", "rid"))
        x = _matrix(shelf["embedding"], dims, index.scale)
        q = _matrix(anchors["embedding"], dims, index.scale)
        own, inverse = np.unique(lists, return_inverse=True)
        members = [np.flatnonzero(inverse == j) for j in range(len(own))]
        _, below, above = index.bounds(q, own)
        visits = np.argsort(-above, axis=1, kind="stable")
        q, x = _exact(q, x)
        lo, hi = _limits(anchors["lo"], q.dtype.type), _limits(anchors["hi"], q.dtype.type)
        n, slots = lo.shape
        best, at = np.full((n, slots, k), -np.inf, dtype=q.dtype), np.full((n, slots, k), len(lists), dtype=np.int64)
        q_label, q_rid = anchors["label"].to_numpy(), anchors["rid"].to_numpy()
        for turn in range(len(own)):
            of = visits[:, turn]
            rows = np.arange(n)
            need = ((below[rows, of][:, None] <= hi) & (above[rows, of][:, None] >= lo)).any(axis=1)
            if not need.any():
                continue
            for j in np.unique(of[need]):
                mine, whom = members[j], np.flatnonzero(need & (of == j))
                step = max(1, _CELLS // len(mine))
                for a in range(0, len(whom), step):
                    w = whom[a : a + step]
                    s = q[w] @ x[mine].T
                    fit = (q_label[w][:, None] == label[mine]) == same
                    if same:
                        fit &= q_rid[w][:, None] != rid[mine]
                    for slot in range(slots):
                        score, col = _top(s, fit & (s >= lo[w, slot, None]) & (s <= hi[w, slot, None]), k)
                        both = np.concatenate([best[w, slot], score], axis=1)
                        cols = np.concatenate([at[w, slot], np.where(score > -np.inf, mine[col], len(lists))], axis=1)
                        take = np.lexsort((cols, -both), axis=1)[:, :k]
                        best[w, slot], at[w, slot] = np.take_along_axis(both, take, 1), np.take_along_axis(cols, take, 1)
                        lo[w, slot] = np.fmax(lo[w, slot], best[w, slot, k - 1])
        row, slot, nth = np.nonzero(best > -np.inf)
        found = at[row, slot, nth]
        out["query"].append(q_rid[row])
        out["slot"].append(slot.astype(np.int32))
        s = best[row, slot, nth]
        out["score"].append(np.where(np.abs(s) < 2.0**63, s, 0).astype(np.int64) + np.where(s >= 2.0**63, _MOST, 0) + np.where(s <= -(2.0**63), _LEAST, 0))
        out["vec_id"].append(shelf["vec_id"].take(pa.array(found)).to_pylist())
        out["row"].append(rid[found])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


class _Search:
    def __init__(self, rows: DataFrame, index: Index, dims: int, blocks: int):
        self.index, self.dims, self.blocks = index, dims, blocks
        first, parts = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>") for x in (index.first, index.parts))
        shelf = F.get(first, F.col("list")) + F.pmod(F.xxhash64("rid"), F.get(parts, F.col("list")).cast("long")).cast("int")
        self.rows = rows.select("rid", "vec_id", "label", "list", "embedding", shelf.alias("shelf"))

    def _turn(self, queries: DataFrame, first: bool, same: bool, k: int) -> DataFrame:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
        routed = queries.mapInArrow(_route(self.index, self.dims, first), names + ", shelves array<int>")
        block = F.pmod(F.xxhash64("rid"), F.lit(self.blocks)).cast("int")
        visits = routed.select("rid", "label", "lo", "hi", "embedding", F.explode("shelves").alias("shelf"), block.alias("block"))
        visits = stored(visits.withColumn("cell", F.col("shelf").cast("long") * self.blocks + F.col("block")), "visits")
        cells = checkpointed(visits.select("cell", F.col("shelf").alias("of")).distinct())
        if cells.count() <= _MOST_BROADCAST:
            cells = F.broadcast(cells)
        sent = self.rows.join(cells, F.col("shelf") == F.col("of")).select("cell", "rid", "vec_id", "label", "list", "embedding")
        return sent.groupBy("cell").cogroup(visits.drop("shelf", "block").groupBy("cell")).applyInArrow(_visit(self.index, self.dims, same, k), _FOUND)

    def top(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """query, slot, score, vec_id, row, nth: the k best rows of each anchor (rid, label, embedding) and slot (lo, hi)."""
        queries = queries.withColumn("lo0", F.col("lo"))
        first = stored(_best(self._turn(queries, True, same, k), k), "first_found")
        kth = first.filter(F.col("nth") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        raised = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
        rest = queries.join(kth, F.col("rid") == F.col("query"), "left").withColumn("lo", raised).drop("query", "kth")
        return stored(_best(first.drop("nth").unionByName(self._turn(rest, False, same, k)), k), "found")


def hard_negatives(
    vectors: DataFrame,
    anchors: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: float = 256.0,
    most_lists: int = 1024,
    sample_rows: int = 16_384,
    shelf_rows: int = 16_384,
) -> DataFrame:
    """The hard negatives of each anchor and positive: RESULT.

    vectors: vec_id, label, embedding.  anchors: which rows are anchors (vec_id divisible by 50, if None).
    window: shares of the positive's score, in percent, between which a negative's lies.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    is_anchor = F.coalesce(F.col("vec_id") % 50 == 0 if anchors is None else anchors, F.lit(False))
    kind = vectors.schema["embedding"].dataType.simpleString()
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), embedding.alias("embedding"), is_anchor.alias("anchor"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    stats = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"), F.count_if("anchor").alias("anchors")).first()
    n, dims = stats["n"], max(1, stats["dims"] or 0)
    if not stats["anchors"]:
        return spark.createDataFrame([], RESULT)
    sample_rows = max(1, min(sample_rows, (1 << 23) // dims))  # 64 MB at most
    share = min(1.0, 1.2 * sample_rows / n)
    sample = rows.filter(F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("embedding").limit(sample_rows).toArrow()
    lists = max(1, min(most_lists, int(n**0.5), (1 << 21) // dims))
    centroids = fit_centroids(_matrix(sample["embedding"], dims, scale), lists) if sample.num_rows else np.zeros((1, dims))
    names = "rid bigint, vec_id bigint, label bigint, embedding " + rows.schema["embedding"].dataType.simpleString() + ", anchor boolean"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), dims, scale)
            of = _nearest(x, centroids)
            far = np.sqrt(((x - centroids[of]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "list", "far"])

    assigned = stored(rows.select(F.monotonically_increasing_id().alias("rid"), *rows.columns).mapInArrow(assign, names + ", list int, far double"), "lists")
    found = assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # at most most_lists
    # Enough shelves for all tasks of a small table, at most shelf_rows rows on each.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shelf_rows = max(256, min(shelf_rows, (1 << 21) // dims, n // (2 * tasks)))
    index = Index(centroids, {r["list"]: r["n"] for r in found}, {r["list"]: r["far"] for r in found}, scale, shelf_rows)
    search = _Search(assigned, index, dims, max(1, -(-stats["anchors"] // max(256, min(16_384, (1 << 21) // dims)))))
    queries = assigned.filter("anchor").select("rid", "vec_id", "label", "embedding")
    whole = queries.select("rid", "label", "embedding", F.array(F.lit(_LEAST)).alias("lo"), F.array(F.lit(_MOST)).alias("hi"))
    near = search.top(whole, True, positives).filter("score >= 0")  # no score lies between two shares of a negative one
    least, most = window
    share_of = lambda p, ends: F.expr("score DIV 100") * p + ends(F.col("score") % 100 * p / 100)
    near = near.select("query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "nth", share_of(least, F.ceil).cast("long").alias("lo"), share_of(most, F.floor).cast("long").alias("hi"))
    slots = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "lo", "hi"))).alias("s")).select("query", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    windows = queries.join(slots, F.col("rid") == F.col("query")).select("rid", "label", "embedding", "lo", "hi")
    far = search.top(windows, False, negatives).select(F.col("query").alias("of"), F.col("slot").alias("of_slot"), F.col("nth").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.join(far, (F.col("query") == F.col("of")) & (F.col("nth") == F.col("of_slot") + 1))
    ids = queries.select(F.col("rid"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(ids, F.col("query") == F.col("rid")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
