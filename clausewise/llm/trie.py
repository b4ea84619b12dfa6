"""A prefix trie of conversations: every distinct sequence of first turns is a node.

A turn is known by a digest of role and text and by its text's bytes; equal conversations are one
sequence with a count, a smallest id and a digest of its ids. Sequences are dealt by the digest of
their first turn to tasks that build pointer dictionary tries and sum them up from the leaves,
iteratively. A first turn whose sequences hold more than `limit` turns is not built in one task: its
common prefix becomes a chain of nodes of its own, and its sequences are dealt anew by the next turn,
again and again, until every subtrie fits. The chains are summed up afterwards, the deepest first.

Bounds: a task builds subtries of `limit` turns each, of about `limit` turns in all; a single
conversation is a row. The ids of one sequence are hashed in ascending order as they stream through
one task (SHA-256 has no parts to merge), in constant memory.

Defined results: null roles and texts are empty; turns come by number, null first, ties by role, then
text; rows without a conv_id are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import cut, partitions

LIMIT = 50_000
NOTHING = hashlib.sha256().hexdigest()
NODE = "g string, up string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each (key, bytes)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    key = lambda t: F.substring(F.sha2(F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]).cast("binary"), 256), 1, 32)
    ordered = F.transform(F.array_sort(F.collect_list("t"), lambda a, b: F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1).when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).when(a["role"] < b["role"], -1).when(a["role"] > b["role"], 1).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0)), lambda t: F.struct(key(t).alias("key"), F.octet_length(t["text"]).cast("long").alias("bytes")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def branched(own: DataFrame, fan: int = 5, heads: int = 9) -> DataFrame:
    """Conversations rebuilt as branches: the first h turns of the one that begins its fan, then their own after the first h; h by crc32 of the id, below heads."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = own.where(F.col("conv_id") % fan == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    return (
        own.withColumn("base", F.col("conv_id") - F.col("conv_id") % fan)
        .withColumn("h", h)
        .join(base, "base", "left")
        .select("conv_id", F.concat(F.when(F.col("head").isNull() | (F.col("h") == 0), F.expr("slice(turns, 1, 0)")).otherwise(F.expr("slice(head, 1, h)")), F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))
    )


def ended(pairs: DataFrame) -> DataFrame:
    """pairs: (s, conv_id). For each s how many ids, the smallest, and the digest of all in ascending order, joined by commas."""

    def hashed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, n, least = None, None, 0, 0
        for pdf in it:
            if not len(pdf):
                continue
            s, ids = pdf["s"].to_numpy(), pdf["conv_id"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            done = []
            for a, b in zip(edges, [*edges[1:], len(s)], strict=True):
                text = ",".join(map(str, ids[a:b].tolist())).encode()
                if s[a] == now:
                    state.update(b"," + text)
                    n += b - a
                    continue
                if now is not None:
                    done.append((now, n, least, state.hexdigest()))
                now, state, n, least = s[a], hashlib.sha256(text), b - a, ids[a]
            yield pd.DataFrame(done, columns=["s", "n", "least", "ends"])
        if now is not None:
            yield pd.DataFrame([(now, n, least, state.hexdigest())], columns=["s", "n", "least", "ends"])

    return pairs.repartition(partitions(pairs.sparkSession), "s").sortWithinPartitions("s", "conv_id").mapInPandas(hashed, "s string, n long, least long, ends string")


def sequences(rebuilt: DataFrame) -> DataFrame:
    """The distinct sequences: (keys, lens, n, least, ends)."""
    named = rebuilt.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.bytes").alias("lens")).withColumn("s", F.sha2(F.array_join("keys", ""), 256))
    whole = named.groupBy("s").agg(F.first("keys").alias("keys"), F.first("lens").alias("lens"))
    return whole.join(ended(named.select("s", "conv_id")), "s").drop("s")


def prefix(depth) -> F.Column:
    return F.sha2(F.array_join(F.slice("keys", F.lit(1), depth), ""), 256)


def grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries whose sequences these are; the node at a subtrie's top has its g and up."""
    kids: list[dict[str, int]] = []
    depth, above, count, least, size, ends, names, up, up_conv = [], [], [], [], [], [], [], [], []

    def new(d: int, parent: int, b: int) -> int:
        kids.append({})
        for column, v in ((depth, d), (above, parent), (count, 0), (least, None), (size, b), (ends, NOTHING), (names, None), (up, None), (up_conv, None)):
            column.append(v)
        return len(kids) - 1

    tops: dict[str, int] = {}
    for g, p, u, uc, keys, lens, n, low, end in pdf[["g", "p", "up", "up_conv", "keys", "lens", "n", "least", "ends"]].itertuples(index=False):
        node = tops.get(g)
        if node is None:
            node = tops[g] = new(p, -1, int(lens[p - 1]))
            names[node], up[node], up_conv[node] = g, u, uc
        d = p
        while True:
            count[node] += n
            least[node] = low if least[node] is None else min(least[node], low)
            if d == len(keys):
                ends[node] = end
                break
            child = kids[node].get(keys[d])
            if child is None:
                child = kids[node][keys[d]] = new(d + 1, node, int(lens[d]))
            node, d = child, d + 1
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for node in range(len(kids) - 1, -1, -1):  # children have larger numbers than their parents
        leaves[node] = leaves[node] or 1
        saved[node] += (count[node] - 1) * size[node]
        if above[node] >= 0:
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    parents = [least[a] if a >= 0 else uc for a, uc in zip(above, up_conv, strict=True)]
    return pd.DataFrame({"g": names, "up": up, "conv_id": least, "depth": depth, "parent_conv_id": parents, "n_convs": count, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


def nodes(rebuilt: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rebuilt: (conv_id, turns). A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rebuilt.sparkSession
    seqs = cut(sequences(rebuilt))
    # a split is a chain of nodes from depth p to depth q, all with the same members; its sequences go on below q
    group = [F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min(F.struct("keys", "lens", "ends")).alias("lo"), F.max("keys").alias("hi"), F.sum(F.size("keys")).alias("turns"), F.count("*").alias("rows")]
    root = seqs.agg(*group).where("rows > 0").select(F.lit("").alias("g"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("up_conv"), "conv_id", "n_convs", F.array().cast("array<long>").alias("lens"), F.when(F.size("lo.keys") == 0, F.col("lo.ends")).otherwise(NOTHING).alias("ends"))
    splits = [cut(root)]
    below = seqs.where(F.size("keys") > 0).join(F.broadcast(splits[0].select(F.col("g").alias("up"), F.col("conv_id").alias("up_conv"))))  # one row: the root
    below = below.withColumn("p", F.lit(1)).withColumn("g", prefix(F.lit(1)))
    built = []
    while True:
        below = cut(below.select("g", "p", "up", "up_conv", "keys", "lens", "n", "least", "ends"))
        stats = below.groupBy("g", "p", "up", "up_conv").agg(*group)
        large = stats.where((F.col("turns") - F.col("rows") * (F.col("p") - 1) > limit) & (F.col("rows") > 1))
        shared = F.array_position(F.zip_with("lo.keys", "hi", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        chained = F.when(shared > 0, shared - 1).otherwise(F.size("hi")).cast("int")
        large = cut(large.withColumn("q", chained).select("g", "p", "q", "up", "up_conv", "conv_id", "n_convs", F.expr("slice(lo.lens, p, q - p + 1)").alias("lens"), F.when(F.size("lo.keys") == F.col("q"), F.col("lo.ends")).otherwise(NOTHING).alias("ends")))
        any_large = not large.isEmpty()
        small = below.join(large.select("g"), "g", "left_anti") if any_large else below
        total = small.agg(F.sum(F.size("keys"))).first()[0] or 0
        buckets = max(1, -(-total // limit), min(partitions(spark), -(-total // 1000)))
        built.append(cut(small.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).groupBy("bucket").applyInPandas(grown, NODE)))
        if not any_large:
            break
        splits.append(large)
        on = below.select("g", "keys", "lens", "n", "least", "ends").join(large.select("g", "q", "conv_id"), "g").where("size(keys) > q")
        below = on.select(prefix(F.col("q") + 1).alias("g"), (F.col("q") + 1).alias("p"), F.col("g").alias("up"), F.col("conv_id").alias("up_conv"), "keys", "lens", "n", "least", "ends")
    out, tops = [b.drop("g", "up") for b in built], None
    for split, local in zip(reversed(splits), reversed(built), strict=True):
        children = local.where("g is not null").select("up", "n_leaves", "saved_tokens")
        children = children if tops is None else children.unionByName(tops)
        sums = children.groupBy(F.col("up").alias("g")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        done = split.join(sums, "g", "left").fillna({"children": 0, "leaves": 1, "saved": 0})
        # bytes saved by the chain from each of its depths down to q, that included
        done = cut(done.withColumn("own", F.expr("transform(lens, x -> x * (n_convs - 1))")))
        at = done.select("*", F.explode(F.expr("sequence(p, q)")).alias("depth"))
        rest = F.expr("saved + aggregate(slice(own, depth - p + 1, size(own)), 0L, (a, x) -> a + x)")
        chain = at.select("conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == F.col("p"), F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(F.col("depth") == F.col("q"), F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), rest.alias("saved_tokens"), F.when(F.col("depth") == F.col("q"), F.col("ends")).otherwise(NOTHING).alias("ends_sha256"))
        out.append(chain)
        tops = done.select("up", F.col("leaves").alias("n_leaves"), F.expr("saved + aggregate(own, 0L, (a, x) -> a + x)").alias("saved_tokens"))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


ORACLE = """
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS INTEGER) AS h FROM c
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5
), m AS (
  SELECT conv_id, len(turns) AS l, d, turns[1:d] AS k, coalesce(octet_length(encode(turns[d].text)), 0) AS b FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)
), n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l = d), '')) AS ends_sha256 FROM m GROUP BY d, k
), f AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.k[1:n.d] = n.k) AS n_children FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1] AND n.d > 0
), u AS (
  SELECT a AS d, k[1:a] AS k, n_children, (n_convs - 1) * b AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f)
), t AS (
  SELECT d, k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY d, k
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN t ON t.d = f.d AND t.k = f.k
"""
