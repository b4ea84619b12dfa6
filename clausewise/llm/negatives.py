"""Hard negatives by a Voronoi-partitioned kNN join.

Vectors are augmented by one coordinate that brings them all to the norm of the longest, anchors by
zero; then the largest inner products are the smallest distances. Cells of pivots (k-means centres of
a bounded sample) partition both sides. Each anchor asks for a shell, the distances between which its
answers must lie: the outer bound comes from the k-th best score within the sample, which no whole
answer can miss, the inner one (negatives only) from the largest score it accepts. A group of anchors
has a pivot, a radius and a shell; a cell of candidates goes to a group only if the triangle bounds of
cell and group allow an answer, and of such a cell only the rows whose own distances do. A join of
numpy blocks within each group and part of its candidates is exact, and parts merge by sorting k
answers each.

Bounds: the sample, the pivots (`MOST_PIVOTS`) and the groups' bounds (`MOST_GROUPS` rows) are all that
reaches the driver or is broadcast; a group has GROUP anchors, more only where anchors exceed
GROUP * MOST_GROUPS / 2; candidates of a group are dealt to parts of about PART rows by their ids.

Defined results: rows with a null id, label or vector, a null or non-finite component, or a squared norm
of 2^62 or more (scores would not fit a long) take no part; shorter vectors end in zeros; of rows that
share an id the smallest (label, vector) stands; an anchor is never its own answer; no anchors, no
positives or an empty table give no rows; other columns are left behind. The same rows come out in any order of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import cut, smallest

SAMPLE = 8192
MOST_PIVOTS = 1024
MOST_GROUPS = 16384
GROUP = 1024
PART = 50_000
#: Numbers of a block of scores that a task holds at once.
BLOCK = 4_000_000
SLACK = 1e-6


class Space(NamedTuple):
    """pivots: augmented centres; top: the longest vector's squared norm."""

    size: int
    top: float
    pivots: np.ndarray

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def distances(self, x: np.ndarray, anchor: bool = False) -> np.ndarray:
        """To each pivot, from candidates or anchors."""
        x = np.column_stack([x, np.zeros(len(x))]) if anchor else self.augmented(x)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * x @ self.pivots.T, 0))

    def reach(self, norms: np.ndarray, score) -> np.ndarray:
        """The distance at which candidates have a score with an anchor."""
        return np.sqrt(np.maximum(norms + self.top - 2 * score, 0))


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """A float array of whole numbers from a column of lists, short ones ending in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, flat = np.diff(np.asarray(column.offsets)), np.asarray(column.flatten(), dtype=np.float64)
    if (n == size).all():
        return flat.reshape(len(n), size)
    out = np.zeros((len(n), size))
    out[np.arange(size) < n[:, None]] = flat
    return out


def scores(a: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Inner products as int64; through floats where they are exact."""
    if top < 2.0**52:
        return (a @ x.T).astype(np.int64)
    return np.einsum("ij,kj->ik", a.astype(np.int64), x.astype(np.int64))


def first(s: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores among those that are ok; ties by place, so candidates come in the order of their ids."""
    (at,) = np.nonzero(ok)
    if len(at) > k:
        own = s[at]
        kth = np.partition(own, len(own) - k)[len(own) - k]
        over = at[own > kth]
        at = np.concatenate([over, at[own == kth][: k - len(over)]])
    return at[np.lexsort((at, -s[at]))]


def pivots(sample: np.ndarray, k: int, seed: int = 5, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        cell = np.argmin((centres * centres).sum(1) - 2 * sample @ centres.T, axis=1)
        for j in np.unique(cell):
            centres[j] = sample[cell == j].mean(0)
    return centres


def cleaned(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, q, norm): whole components of the rows that take part, one row for an id."""
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))
    rows = rows.withColumn("norm", F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).where(F.col("norm") < 2.0**62)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q", "norm")).alias("r")).select("vec_id", "r.label", "r.q", "r.norm")


def placed(rows: DataFrame, space: Space) -> DataFrame:
    """rows with their cell and their distance to its pivot."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.distances(matrix(b.column("q"), space.size))
            cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "away"])

    return rows.mapInArrow(cells, "vec_id long, label long, q array<double>, norm double, cell int, away double")


class Kind(NamedTuple):
    """Which candidates answer an anchor: `positives` nearest of its label, or `negatives` of each positive's band."""

    positives: int
    negatives: int
    low: int
    high: int

    def bands(self, positive_scores) -> list[tuple[int, int]]:
        return [(-((-self.low * int(p)) // 100), self.high * int(p) // 100) for p in positive_scores]


def pivoted(anchors: DataFrame, space: Space) -> DataFrame:
    """anchors with their pivot and their distance to it."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.distances(matrix(b.column("q"), space.size), anchor=True)
            pivot = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int64)), pa.array(d[np.arange(len(d)), pivot])], names=[*b.schema.names, "pivot", "off"])

    return anchors.mapInArrow(near, "vec_id long, label long, q array<double>, norm double, pivot long, off double")


def asked(anchors: DataFrame, space: Space, kind: Kind, sample: tuple[np.ndarray, np.ndarray, np.ndarray], positive: bool) -> DataFrame:
    """anchors with their shell: least and greatest distance of an answer."""
    ids, labels, x = sample

    def shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = matrix(b.column("q"), space.size)
            own, label, norms = (np.asarray(b.column(c)) for c in ("vec_id", "label", "norm"))
            near, far = np.zeros(len(a)), np.full(len(a), -1.0)
            given = None if positive else b.column("scores").to_pylist()
            for i in range(len(a)):
                s = scores(a[i : i + 1], x, space.top)[0]
                same = (labels == label[i]) & (ids != own[i])
                if positive:
                    at = first(s, same, kind.positives)
                    worst = [s[at[-1]] if len(at) == kind.positives else -space.top]
                    best = None
                else:
                    worst, best = [], None
                    for low, high in kind.bands(given[i]):
                        if low <= high:
                            at = first(s, (labels != label[i]) & (s >= low) & (s <= high), kind.negatives)
                            worst.append(s[at[-1]] if len(at) == kind.negatives else low)
                            best = high if best is None else max(best, high)
                if worst:
                    far[i] = space.reach(norms[i], float(min(worst)))
                    near[i] = 0 if best is None else space.reach(norms[i], float(best))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(far)], names=[*b.schema.names, "near", "far"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(shells, f"{fields}, near double, far double").where("far >= 0")


def routed(rows: DataFrame, space: Space, cells: dict[int, tuple[float, float]], groups: list[tuple[int, float, float, float]], parts: int) -> DataFrame:
    """Candidates in packed blocks, each to the groups it may serve. groups: (group, radius, near, far)."""
    k, slack = len(space.pivots), SLACK * np.sqrt(space.top) + 1e-3
    of = np.array([g[0] for g in groups], np.int64)
    pivot = of % k
    radius, near, far = (np.array([g[i] for g in groups]) for i in (1, 2, 3))
    sq = (space.pivots * space.pivots).sum(1)
    between = np.sqrt(np.maximum(sq[:, None] + sq[pivot] - 2 * space.pivots @ space.pivots[pivot].T, 0))
    least = np.array([cells.get(c, (0.0, 0.0))[0] for c in range(k)])
    most = np.array([cells.get(c, (0.0, 0.0))[1] for c in range(k)])
    nearest = np.maximum(between - most[:, None], least[:, None] - between)  # a cell's row to a group's pivot, at least
    serves = (nearest - radius <= far + slack) & (between + most[:, None] + radius >= near - slack)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("q"), space.size)
            ids, labels, cell = (np.asarray(b.column(c)) for c in ("vec_id", "label", "cell"))
            d = space.distances(x)
            kind = next((t for t in (np.int8, np.int16, np.int32) if not len(x) or np.abs(x).max() <= np.iinfo(t).max), np.int64)
            whole, part = x.astype(kind), (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
            out = []
            for j in range(len(of)):
                rows_of = np.flatnonzero(serves[cell, j])
                own = d[rows_of, pivot[j]]
                rows_of = rows_of[(own - radius[j] <= far[j] + slack) & (own + radius[j] >= near[j] - slack)]
                for p in np.unique(part[rows_of]):
                    at = rows_of[part[rows_of] == p]
                    out.append((int(of[j]), int(p), np.dtype(kind).str, ids[at].tobytes(), labels[at].tobytes(), whole[at].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["group", "part", "kind", "ids", "labels", "block"])

    return rows.mapInArrow(blocks, "group long, part long, kind string, ids binary, labels binary, block binary")


def joined(candidates: DataFrame, anchors: DataFrame, space: Space, kind: Kind, positive: bool, parts: int) -> DataFrame:
    """(anchor_id, nth, ids, scores): the best answers of each part, nth being a positive's place (0 in the first join)."""
    size, top = space.size, space.top

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids = np.concatenate([np.frombuffer(b, np.int64) for b in left.column("ids").to_pylist()])
            labels = np.concatenate([np.frombuffer(b, np.int64) for b in left.column("labels").to_pylist()])
            x = np.concatenate([np.frombuffer(b, np.dtype(t)).reshape(-1, size).astype(np.float64) for b, t in zip(left.column("block").to_pylist(), left.column("kind").to_pylist(), strict=True)])
            order = np.argsort(ids)
            ids, labels, x = ids[order], labels[order], x[order]
            a = matrix(right.column("q"), size)
            own, label = np.asarray(right.column("vec_id")), np.asarray(right.column("label"))
            given = None if positive else right.column("scores").to_pylist()
            step = max(1, BLOCK // len(ids))
            for i in range(0, len(a), step):
                block = scores(a[i : i + step], x, top)
                for j in range(len(block)):
                    s, n = block[j], i + j
                    if positive:
                        wanted = [(0, first(s, (labels == label[n]) & (ids != own[n]), kind.positives))]
                    else:
                        other = labels != label[n]
                        wanted = [(p, first(s, other & (s >= low) & (s <= high), kind.negatives)) for p, (low, high) in enumerate(kind.bands(given[n])) if low <= high]
                    out += [(int(own[n]), p, ids[at].tolist(), s[at].tolist()) for p, at in wanted if len(at)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor_id", "nth", "ids", "scores"), columns, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)})

    each = anchors.withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    return candidates.groupBy("group", "part").cogroup(each.groupBy("group", "part")).applyInArrow(local, "anchor_id long, nth int, ids array<long>, scores array<long>")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k first of all parts' answers: (anchor_id, nth, found), found holding (lost, id), lost the negated score."""
    pairs = F.transform(F.arrays_zip("scores", "ids"), lambda z: F.struct((-z["scores"]).alias("lost"), z["ids"].alias("id")))
    return found.groupBy("anchor_id", "nth").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("found"))


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, sample: int = SAMPLE, group: int = GROUP, part: int = PART) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, label, embedding. anchor: which rows are anchors. For each anchor and each of its
    `positives` best other rows of its label, the best `negatives` rows of other labels whose score is
    within low to high per cent of the positive's.
    """
    spark = vectors.sparkSession
    kind = Kind(positives, negatives, low, high)
    rows = cut(cleaned(vectors.select("vec_id", "label", "embedding"), scale))
    told = rows.agg(F.count("*"), F.max("norm"), F.max(F.size("q")), F.count_if(anchor)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not told[3]:
        return spark.createDataFrame([], schema)
    n, size = told[0], max(1, told[2])
    drawn = smallest(rows, "vec_id", sample).select("vec_id", "label", "q").toArrow()
    x = matrix(drawn.column("q"), size)
    near_by = (np.asarray(drawn.column("vec_id")), np.asarray(drawn.column("label")), x)
    bare = Space(size, float(told[1]) + 1, np.zeros((0, size + 1)))
    space = bare._replace(pivots=pivots(bare.augmented(x), int(min(MOST_PIVOTS, max(4, told[3] // 512)))))
    rows = cut(placed(rows, space))
    cells = {r["cell"]: (r["lo"], r["hi"]) for r in rows.groupBy("cell").agg(F.min("away").alias("lo"), F.max("away").alias("hi")).collect()}
    parts = max(1, -(-n // part))
    most = max(group, 2 * told[3] // MOST_GROUPS)

    anchors = cut(pivoted(rows.where(anchor).select("vec_id", "label", "q", "norm"), space))
    subs = anchors.groupBy("pivot").count().select("pivot", F.expr(f"greatest(1L, cast(ceil(count / {most}) as long))").alias("subs"))  # a row for each pivot
    group = F.col("pivot") + len(space.pivots) * F.pmod(F.xxhash64("vec_id"), F.col("subs"))
    anchors = anchors.join(F.broadcast(subs), "pivot").select("vec_id", "label", "q", "norm", "off", group.alias("group"))

    def answered(anchors: DataFrame, positive: bool) -> DataFrame:
        shells = cut(asked(anchors, space, kind, near_by, positive))
        bounds = shells.groupBy("group").agg(F.max("off"), F.min("near"), F.max("far")).collect()
        if not bounds:
            return spark.createDataFrame([], "anchor_id long, nth int, found array<struct<lost:long,id:long>>")
        sent = routed(rows, space, cells, [tuple(b) for b in bounds], parts)
        return best(joined(sent, shells.drop("off", "near", "far"), space, kind, positive, parts), positives if positive else negatives)

    friends = cut(answered(anchors, True).select("anchor_id", "found"))
    pairs = anchors.join(friends, anchors["vec_id"] == friends["anchor_id"]).select("vec_id", "label", "q", "norm", "off", "group", F.transform("found", lambda f: -f["lost"]).alias("scores"))
    foes = answered(pairs, False)
    out = foes.join(friends.withColumnRenamed("found", "friends"), "anchor_id").select("anchor_id", F.expr("friends[nth]").alias("p"), F.posexplode("found").alias("at", "f"))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"), (-F.col("p.lost")).alias("positive_score"), (-F.col("f.lost")).alias("negative_score"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 10
"""
