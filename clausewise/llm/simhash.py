"""SimHash near duplicates, found by vantage-point trees over Hamming distance.

A fingerprint's bit is set if it is set in over half of the XXH64 values of a text's word shingles.
Fingerprints link at `radius` differing bits or fewer, and linked documents form components.

Equal fingerprints are one point. A vantage-point tree over a bounded sample of the points splits
Hamming space into shards: at a node with vantage v and limit m, points with d(v, x) <= m go left,
those with d(v, x) > m - radius go right. By the triangle inequality two points within the radius
that part at a node meet on its right, since d(v, x) >= d(v, y) - radius > m - radius; so every pair
meets in a shard, and only points near a boundary are copied. Inside a shard the same tree, built on
the shard's points, prunes down to leaves, where points that agree in one of radius + 1 ranges of bits
are compared (two within the radius must). A shard hands on a spanning star of each of its local
components, never its pairs; `components` joins the shards.

Bounds: the driver's tree is built on `sample` points and has about `REGIONS` regions at most; where
these hold more than a shard, each gets a tree of its own, built on an executor from `sample` of its
points. Copies of a point grow with the depth of the trees, so a shard takes up to `MOST` points before
more shards are made. A shard holds distinct fingerprints only; a region that no tree can split lies
within a few bits of one point, and so is small by counting (43,745 fingerprints within three bits of
one), however many documents are there.

Defined results: null and wordless texts have fingerprint zero and link like any other; fewer words
than a shingle give one shingle; a null doc_id takes part but never names a component (null if no
other id is there); repeated rows stay. `near_duplicates` returns its three columns alone;
`representatives` returns the columns of its input, whatever their names and types.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import col, cut, partitions, scratch, slices, tidy
from clausewise.llm.components import components

LEAF = 16_384
REGIONS = 256
#: Points of a shard: at least, and at most if the cluster has so many tasks anyway.
LEAST, MOST = 50_000, 400_000


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text: lower-cased A-Z, words parted by ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(w) - words + 1]
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes, as an unsigned integer."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 255 * 256):
        bits = np.unpackbits(h[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(words: int, column: str = "text") -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series(np.array([fingerprint(t, words) for part in slices(texts) for t in part], dtype="<u8").view("<i8"))

    return of(column)


def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


@dataclass
class Tree:
    """Nodes: (vantage, limit, left, right); a leaf has left = -1 and its number in right."""

    nodes: list[tuple[int, int, int, int]]
    leaves: int
    radius: int

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf's number and the places of its points."""
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, idx = stack.pop()
            if not len(idx):
                continue
            vantage, limit, left, right = self.nodes[node]
            if left < 0:
                yield right, idx
                continue
            d = distance(points[idx], vantage)
            stack += [(left, idx[d <= limit]), (right, idx[d > limit - self.radius])]


def split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage and a limit that part these points well for the copies they cost; None if nothing parts them."""
    n = len(points)
    best, found = 0.9, None
    for vantage in rng.choice(points, min(6, n), replace=False):
        below = np.cumsum(np.bincount(distance(points, vantage), minlength=65))[:64]
        right = n - np.concatenate([np.zeros(min(radius, 64), dtype=np.int64), below])[:64]
        p = np.clip(below / n, 1e-9, 1 - 1e-9)
        cost = np.log((below + right) / n) / -(p * np.log(p) + (1 - p) * np.log(1 - p))
        cost[(p < 0.3) | (p > 0.7) | (right >= n)] = 1e9
        limit = int(np.argmin(cost))
        if cost[limit] < best:
            best, found = cost[limit], (int(vantage), limit)
    return found


def build(points: np.ndarray, radius: int, most: float, seed: int = 11) -> Tree:
    """A tree whose leaves hold so many of the points at most, where they can be parted."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0
    stack = [(points, -1, 0)]
    while stack:
        own, parent, side = stack.pop()
        at = len(nodes)
        if parent >= 0:
            v, m, left, right = nodes[parent]
            nodes[parent] = (v, m, at, right) if side == 0 else (v, m, left, at)
        cutting = split(own, radius, rng) if len(own) > most else None
        if cutting is None:
            nodes.append((0, 0, -1, leaves))
            leaves += 1
            continue
        d = distance(own, cutting[0])
        nodes.append((*cutting, 0, 0))
        stack += [(own[d > cutting[1] - radius], at, 1), (own[d <= cutting[1]], at, 0)]
    return Tree(nodes, leaves, radius)


def close(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within the radius, some of them more than once: such a pair agrees in one of radius + 1 ranges of bits."""
    ranges = min(radius + 1, 64)
    for k in range(ranges):
        low, high = 64 * k // ranges, 64 * (k + 1) // ranges
        key = (points >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(key, kind="stable")
        key, own, at = key[order], points[order], np.arange(len(points))
        for step in range(1, len(points)):
            at = at[: np.searchsorted(at, len(points) - step)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count(own[at] ^ own[at + step]) <= radius]
            yield order[near], order[near + step]


def roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def stars(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct points, those with a link in reach and the smallest point they are joined to here."""
    root = np.arange(len(points))
    for _, idx in build(points, radius, LEAF, seed=3).route(points):
        for a, b in close(points[idx], radius):
            a, b = root[idx[a]], root[idx[b]]
            while len(a := a[(apart := a != b)]):  # each round hands every root the smallest it meets
                b = b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                root = roots(root)
                a, b = root[a], root[b]
    joined = np.nonzero(root != np.arange(len(points)))[0]
    return points[joined], points[root[joined]]


def routed(trees: dict[int, Tree], *columns: str) -> Column:
    """The shards of a point: (region, fp) columns, or fp alone where there is but one tree, that of region 0."""

    @F.pandas_udf("array<long>")
    def shards(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in it:
            batch = batch if isinstance(batch, tuple) else (batch,)
            fps = batch[-1].to_numpy(dtype="<i8").view("<u8")
            region = batch[0].to_numpy() if len(batch) > 1 else np.zeros(len(fps), dtype=np.int64)
            own: list[list[int]] = [[] for _ in range(len(fps))]
            for r in np.unique(region).tolist():
                places = np.flatnonzero(region == r)
                if r not in trees:
                    for i in places.tolist():
                        own[i].append(r << 32)
                    continue
                for leaf, idx in trees[r].route(fps[places]):
                    for i in places[idx].tolist():
                        own[i].append((r << 32) + leaf)
            yield pd.Series(own)

    return shards(*columns)


def links(points: DataFrame, radius: int = 3, shard: int | None = None, sample: int = 8192, regions: int = REGIONS) -> DataFrame:
    """points: distinct fingerprints (fp). Returns (u, v): links that span every component of the full graph of links."""
    spark = points.sparkSession
    n = points.count()
    shard = shard or min(MOST, max(LEAST, n // (4 * partitions(spark))))
    some = np.array([r["fp"] for r in points.select("fp").orderBy(F.hash("fp"), "fp").limit(sample).collect()], dtype="<i8").view("<u8")
    tree = build(some, radius, max(8.0, len(some) * max(shard, n / regions) / max(n, 1)))  # no more nodes than the sample has points
    placed = points.select("fp", F.explode(routed({0: tree}, "fp")).alias("shard"))
    if n > shard * regions:  # each region that holds more than a shard gets a tree of its own
        placed = cut(placed)
        sizes = placed.groupBy("shard").count().where(F.col("count") > 2 * shard)
        chosen = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(float(sample << 20)) / F.col("count")

        def built(pdf: pd.DataFrame) -> pd.DataFrame:
            own = np.sort(pdf["fp"].to_numpy(dtype="<i8").view("<u8"))
            tree = build(own, radius, max(8.0, len(own) * shard / pdf["count"].iloc[0]))
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

        trees = placed.join(F.broadcast(sizes), "shard").where(chosen).groupBy("shard").applyInPandas(built, "shard long, tree binary").collect()  # a row for each region
        placed = placed.select("fp", F.explode(routed({r["shard"]: pickle.loads(r["tree"]) for r in trees}, "shard", "fp")).alias("shard"))

    def spanned(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = stars(np.sort(pdf["fp"].to_numpy(dtype="<i8").view("<u8")), radius)
        return pd.DataFrame({"u": u.view("<i8"), "v": v.view("<i8")})

    return placed.groupBy("shard").applyInPandas(spanned, "u long, v long")


def groups(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps: (fp). Returns (fp, root) for the fingerprints that link to another; root is one of them, the same for all that are joined."""
    points = cut(fps.where("fp is not null").select("fp").distinct())
    return components(links(points, radius)).select(F.col("node").alias("fp"), "root")


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """documents with fingerprint (16 hex digits) and component_id (smallest doc_id in reach)."""
    rows = cut(documents.select("doc_id", fingerprints(words).alias("fp")))
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = cut(groups(points.select("fp"), radius))
    named = joined.join(points, "fp").groupBy("root").agg(F.min("first").alias("first"))
    own = points.join(joined, "fp", "left").join(named.select("root", F.col("first").alias("least")), "root", "left").select("fp", F.coalesce(F.least("least", "first"), "first").alias("component_id"))
    return rows.join(own, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(documents: DataFrame, words: int = 3, radius: int = 3, similar: float | None = None) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id (then of the other columns).

    Rows of one fingerprint are first brought down to one (partial minima of ids, so a hot group is a few
    rows to a task); only ids and fingerprints take part in the linking. With `similar`, texts whose five-word
    shingles have that similarity are linked as well (`similar.joined`), and both links form the groups.
    """
    from clausewise.llm import similar as shingles

    own = documents.columns
    spark = documents.sparkSession
    folder = scratch(spark, "fingerprints")
    keyed = [] if similar is None else [shingles.signs().alias("signs")]
    plain = [col(c).cast("string") if "map<" in kind or "variant" in kind else col(c) for c, kind in documents.dtypes]  # these have no hash
    rows = documents.select(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(own)]).alias("d"), "doc_id", "text", F.xxhash64(*plain).alias("content"), F.monotonically_increasing_id().alias("row"))
    rows.select("d", "doc_id", "content", "row", fingerprints(words).alias("fp"), *keyed).write.parquet(folder)
    marked = spark.read.parquet(folder)
    text = F.col(f"d.c{own.index('text')}").alias("text")
    # of each fingerprint the first document: ids, a hash of all columns and a row number, so no text is compared and a hot group is a few rows to a task
    first = cut(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "row")).alias("first")))
    joined = groups(first.select("fp"), radius)
    if similar is not None:
        joined = cut(joined)
        root = F.coalesce("root", "fp")
        each = marked.groupBy(F.col("signs.key").alias("key")).agg(F.min("signs.size").alias("size"), F.min("signs.bits").alias("bits"), F.min("fp").alias("fp"))
        labels = cut(each.join(joined, "fp", "left").select("key", "size", "bits", root.alias("label")))
        more = shingles.joined(marked.select("signs.key", text), labels, least=similar).select(F.col("node").alias("label"), F.col("root").alias("top"))
        joined = first.select("fp").join(joined, "fp", "left").select("fp", root.alias("label")).join(more, "label", "left").select("fp", F.coalesce("top", "label").alias("root"))
    best = cut(first.join(joined, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("best")).select(F.col("best.row").alias("row")))
    tidy(spark)
    kept = marked.select("d", "row").join(best, "row", "left_semi")
    return kept.select(*[F.col(f"d.c{i}").alias(c) for i, c in enumerate(own)])


__all__ = ["fingerprint", "fingerprints", "groups", "links", "near_duplicates", "representatives"]
