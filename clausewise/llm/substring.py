"""Removal of repeated passages: every window of words that also starts earlier goes.

1. Equal texts become one, with the smallest id that has it; texts are dealt to parts of about
   PART_CHARS and stay there (a bucketed table), so no later pass moves them.
2. Each part sketches its windows: a count-min sketch of DEPTH rows, sent as the sorted cells that the
   part fills, in blocks. The blocks of all parts are added up; a cell that two parts or two windows
   fill may hold a repeated window, and each part is told which of its own cells these are.
3. A second pass over the parts sends only windows all of whose cells are such: a sketch never
   counts too low, so none is lost. They are grouped exactly, by 128 bits made of the words' bytes, with
   the smallest id of each; a part is told which of its windows start in an earlier document.
4. A third pass covers words and joins the rest.

The sketch has about four to twelve cells for each window at any size, for its width follows the
characters of the texts; it lies on no machine as a whole. A passage in a third of all documents is one
entry from each part. Equal texts after the first need no pass: all their windows start earlier.

Defined results: null has no words; null ids come before all others, and rows that share an id are
apart (neither is earlier), unless their texts are equal too: then they are one document and have the same result;
texts of fewer words than a window lose nothing; an empty table gives no rows; other columns pass
through `without_repeats`, an own column named like a result gives way.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import cut, partitions, tidy, with_result

WINDOW = 20
PART_CHARS = 6_000_000
#: Bytes of text that are turned into arrays at once; a longer text is a slice of its own.
SLICE = 1_000_000
DEPTH = 2
#: Cells of a block of the sketch, as a power of two.
BLOCK_BITS = 24
LONG_WORD = 256
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
EARLIEST = -(2**63)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of 64 bits that spreads them."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each word's bytes; words of LONG_WORD bytes or more by a cryptographic one."""
    n = len(data) + 1
    if base not in _powers or len(_powers[base][0]) < n:
        _powers[base] = powers(base, n), powers(pow(int(base), -1, 2**64), n)
    up, down = _powers[base]
    sums = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: n - 1], out=sums[1:])
    h = mixed((sums[end] - sums[start]) * down[start])
    if n > 2 * SLICE:
        del _powers[base]
    for i in np.flatnonzero(end - start >= LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=int(base).to_bytes(8, "little")).digest(), "little")
    return h


def rolled(h: np.ndarray, window: int, base: int) -> np.ndarray:
    """A hash of each run of `window` words, by doubling."""
    out, length, at = None, 0, 0
    run, size, c = h, 1, int(base)
    while window >> at:
        if window >> at & 1:
            n = len(h) - length - size + 1
            out = run if out is None else out[:n] * np.uint64(pow(c, size, 2**64)) + run[length : length + n]
            length += size
        run = run[:-size] * np.uint64(pow(c, size, 2**64)) + run[size:]
        size, at = 2 * size, at + 1
    return mixed(out[: len(h) - window + 1])


def sliced(texts: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of texts: the first one's number, their bytes, and where each begins, the end included."""
    done = 0
    for chunk in texts.chunks:
        chunk = chunk.cast(pa.large_binary())
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(chunk):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
            yield done + a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b
        done += len(chunk)


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's start, end and text."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    return starts, ends, np.searchsorted(begins, starts, side="right") - 1


def windows(texts: pa.ChunkedArray, window: int, both: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each stretch: number of its first text, bytes, words' starts, ends and texts, and the windows: first word, hash, second hash."""
    for number, data, begins in sliced(texts):
        start, end, text = words(data, begins)
        whole = np.flatnonzero(text[window - 1 :] == text[: len(text) - window + 1]) if len(text) >= window else np.zeros(0, np.int64)
        h = [rolled(word_hashes(data, start, end, base), window, base)[whole] if len(whole) else np.zeros(0, np.uint64) for base in (BASES if both else BASES[:1])]
        yield number, data, start, end, text, whole, h[0], (h[1] if both else None)


def packed(a: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed: high bytes of small numbers cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    raw, size = zstandard.ZstdDecompressor().decompress(b), np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel() if raw else np.zeros(0, kind)


def rising(a: np.ndarray) -> bytes:
    """Sorted numbers, as differences."""
    return packed(np.diff(a, prepend=a.dtype.type(0)))


def risen(b: bytes, kind) -> np.ndarray:
    return np.cumsum(unpacked(b, kind), dtype=kind)


def by_block(sorted_keys: np.ndarray, shift: int) -> Iterator[tuple[int, slice]]:
    if not len(sorted_keys):
        return
    block = sorted_keys >> np.uint64(shift) if shift < 64 else np.zeros(len(sorted_keys), np.uint64)
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    for a, b in zip(edges, [*edges[1:], len(block)], strict=True):
        yield int(block[a]), slice(a, b)


def table(rows: list[tuple], **fields: pa.DataType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(fields.items(), columns, strict=True)})


def sketched(parts: DataFrame, window: int, bits: int) -> DataFrame:
    """A part's sketch: (layer, block, part, cells, again): sorted cells, and of each whether two of the part's windows fill it."""

    def sketch(t: pa.Table) -> pa.Table:
        hashes = [w[6] for w in windows(t.column("text"), window, False)]
        h, out = np.concatenate([*hashes, np.zeros(0, np.uint64)]), []
        for layer in range(DEPTH):
            cells, n = np.unique(mixed(h, layer) >> np.uint64(64 - bits), return_counts=True)
            for block, at in by_block(cells, BLOCK_BITS):
                out.append((layer, block, t.column("part")[0].as_py(), rising((cells[at] & np.uint64(2**BLOCK_BITS - 1)).astype(np.uint32)), np.packbits(n[at] > 1).tobytes()))
        return table(out, layer=pa.int32(), block=pa.int64(), part=pa.int64(), cells=pa.binary(), again=pa.binary())

    return parts.groupBy("part").applyInArrow(sketch, "layer int, block long, part long, cells binary, again binary")


def merged(sketches: DataFrame) -> DataFrame:
    """The sum of the parts' sketches, told back: (part, layer, block, cells), the part's cells that count two or more."""

    def add(t: pa.Table) -> pa.Table:
        each = [risen(b, np.uint32) for b in t.column("cells").to_pylist()]
        again = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(c)).astype(bool) for b, c in zip(t.column("again").to_pylist(), each, strict=True)]
        full, twice = np.zeros(2**BLOCK_BITS, bool), np.zeros(2**BLOCK_BITS, bool)
        for c, two in zip(each, again, strict=True):
            twice[c] |= full[c] | two
            full[c] = True
        out = []
        for part, c in zip(t.column("part").to_pylist(), each, strict=True):
            if len(own := c[twice[c]]):
                out.append((part, t.column("layer")[0].as_py(), t.column("block")[0].as_py(), rising(own)))
        return table(out, part=pa.int64(), layer=pa.int32(), block=pa.int64(), cells=pa.binary())

    return sketches.groupBy("layer", "block").applyInArrow(add, "part long, layer int, block long, cells binary")


def lowest(h1: np.ndarray, h2: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order, with the lowest rank of each."""
    order = np.lexsort((rank, h2, h1))
    h1, h2, rank = h1[order], h2[order], rank[order]
    new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, bool)
    return h1[new], h2[new], rank[new]


def suspected(parts: DataFrame, told: DataFrame, window: int, bits: int, shift: int) -> DataFrame:
    """Windows that the sketch counts twice or more, each once from a part: (block, part, h1, h2, first)."""

    def send(t: pa.Table, cells: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows and cells.num_rows:
            own: list[np.ndarray] = []
            for layer in range(DEPTH):
                got = [risen(c, np.uint32).astype(np.uint64) | np.uint64(b << BLOCK_BITS) for k, b, c in zip(cells.column("layer").to_pylist(), cells.column("block").to_pylist(), cells.column("cells").to_pylist(), strict=True) if k == layer]
                own.append(np.sort(np.concatenate([*got, np.zeros(0, np.uint64)])))
            first, kept = np.asarray(t.column("first")), []
            for number, _, _, _, text, whole, h1, h2 in windows(t.column("text"), window, True):
                ok = np.ones(len(h1), bool)
                for layer, known in enumerate(own):
                    cell = mixed(h1, layer) >> np.uint64(64 - bits)
                    ok &= (known[np.minimum(np.searchsorted(known, cell), len(known) - 1)] == cell) if len(known) else False
                kept.append((h1[ok], h2[ok], first[number + text[whole[ok]]]))
            h1, h2, rank = lowest(*(np.concatenate(c) for c in zip(*kept, strict=True))) if kept else (np.zeros(0, np.uint64),) * 3
            part = t.column("part")[0].as_py()
            out = [(block, part, rising(h1[at]), packed(h2[at]), packed(rank[at].astype(np.int64))) for block, at in by_block(h1, shift)]
        return table(out, block=pa.int64(), part=pa.int64(), h1=pa.binary(), h2=pa.binary(), first=pa.binary())

    return parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(send, "block long, part long, h1 binary, h2 binary, first binary")


def grouped(sent: DataFrame) -> DataFrame:
    """Exact groups of windows, told back: (part, h1, h2), those that start in an earlier document than any of the part's."""

    def group(t: pa.Table) -> pa.Table:
        each = [(risen(a, np.uint64), unpacked(b, np.uint64), unpacked(c, np.int64)) for a, b, c in zip(*(t.column(c).to_pylist() for c in ("h1", "h2", "first")), strict=True)]
        n = [len(e[0]) for e in each]
        h1, h2, rank = (np.concatenate(c) for c in zip(*each, strict=True))
        order = np.lexsort((rank, h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        least = np.empty(len(rank), np.int64)
        least[order] = rank[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        out, at = [], 0
        for part, k in zip(t.column("part").to_pylist(), n, strict=True):
            own = slice(at, at + k)
            late = least[own] < rank[own]
            if late.any():
                out.append((part, rising(h1[own][late]), packed(h2[own][late])))
            at += k
        return table(out, part=pa.int64(), h1=pa.binary(), h2=pa.binary())

    return sent.groupBy("block").applyInArrow(group, "part long, h1 binary, h2 binary")


def stripped(parts: DataFrame, late: DataFrame, window: int, texts: bool) -> DataFrame:
    """(digest, first, n_words, n_removed, kept), kept being a text or its SHA-256."""

    def strip(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([], digest=pa.string(), first=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept=pa.string())
        first, number_of = np.asarray(t.column("first")), t.num_rows
        known = [(risen(a, np.uint64), unpacked(b, np.uint64)) for a, b in zip(told.column("h1").to_pylist(), told.column("h2").to_pylist(), strict=True)]
        far1, far2 = (np.concatenate([*c, np.zeros(0, np.uint64)]) for c in (zip(*known, strict=True) if known else ((), ())))
        every = [(number + text[whole], h1, h2) for number, _, _, _, text, whole, h1, h2 in windows(t.column("text"), window, True)]
        at, h1, h2 = (np.concatenate(c) for c in zip(*every, strict=True))
        rank, place = first[at], np.arange(len(at))
        # windows told of come before all others of their kind
        a, b = np.concatenate([far1, h1]), np.concatenate([far2, h2])
        far = np.arange(len(a)) < len(far1)
        r, p, w = np.concatenate([np.full(len(far1), EARLIEST, np.int64), rank]), np.concatenate([np.full(len(far1), -1), place]), np.concatenate([np.full(len(far1), -1), at])
        order = np.lexsort((p, w, r, ~far, b, a))
        a, b, r, w, p, far = a[order], b[order], r[order], w[order], p[order], far[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
        again = np.concatenate([[False], (w[1:] == w[:-1]) & ~new[1:]]) if len(a) else np.zeros(0, bool)  # the same text has it earlier
        gone = (far[head] | (r[head] < r) | again) & ~far
        removed = np.zeros(len(at), bool)
        removed[p[gone]] = True
        out, done = [], 0
        digests = t.column("digest").to_pylist()
        for number, data, start, end, text, whole, own, _ in windows(t.column("text"), window, False):
            hit = np.zeros(len(start) + 1, np.int64)
            lost = whole[removed[done : done + len(own)]]
            done += len(own)
            np.add.at(hit, lost, 1)
            np.add.at(hit, lost + window, -1)
            stays = np.cumsum(hit[:-1]) == 0
            held, edges = data.tobytes(), np.searchsorted(text, np.arange(int(text[-1]) + 2 if len(text) else 1))
            for k in range(len(edges) - 1):
                a, b = int(edges[k]), int(edges[k + 1])
                keep = stays[a:b]
                if b == a:
                    continue
                if keep.all():
                    kept = b" ".join(held[start[a] : end[b - 1]].split())
                else:
                    kept = b" ".join([held[s:e] for s, e in zip(start[a:b][keep].tolist(), end[a:b][keep].tolist(), strict=True)])
                out.append((digests[number + k], int(first[number + k]), b - a, int(b - a - keep.sum()), kept.decode() if texts else hashlib.sha256(kept).hexdigest()))
                digests[number + k] = None
        nothing = "" if texts else hashlib.sha256().hexdigest()
        out += [(digests[k], int(first[k]), 0, 0, nothing) for k in range(number_of) if digests[k] is not None]
        return table(out, digest=pa.string(), first=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept=pa.string())

    return parts.groupBy("part").cogroup(late.groupBy("part")).applyInArrow(strip, "digest string, first long, n_words long, n_removed long, kept string")


def judged(documents: DataFrame, window: int, texts: bool) -> DataFrame:
    """documents: (doc_id, text). For each distinct text (digest, first, n_words, n_removed, kept), as judged in the document that has it first."""
    spark = documents.sparkSession
    told = documents.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = min(60, max(BLOCK_BITS, int(told).bit_length()))
    shift = 64 - max(0, int(told // (2 * PART_CHARS)).bit_length())
    n = max(partitions(spark), -(-told // PART_CHARS))
    rows = documents.select(F.coalesce(F.col("doc_id"), F.lit(EARLIEST)).alias("first"), "text").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    distinct = rows.groupBy("digest").agg(F.min("first").alias("first"), F.coalesce(F.first("text", ignorenulls=True), F.lit("")).alias("text"))
    name = f"parts_{uuid.uuid4().hex}"
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(n)))
    dealt.repartition(n, "part").write.bucketBy(n, "part").format("parquet").saveAsTable(name)
    tidy(spark)
    try:
        parts = spark.table(name)
        cells = cut(merged(sketched(parts, window, bits)))
        late = cut(grouped(suspected(parts, cells, window, bits, shift)))
        return cut(stripped(parts, late, window, texts))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def results(documents: DataFrame, window: int, texts: bool) -> DataFrame:
    """documents with __n_words, __n_removed and __kept (null if all or nothing of a later copy stays)."""
    found = judged(documents.select("doc_id", "text"), window, texts)
    keyed = documents.withColumn("__digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    found = found.select(F.col("digest").alias("__digest"), F.col("first").alias("__first"), F.col("n_words").alias("__n_words"), F.col("n_removed").alias("__n_removed"), F.col("kept").alias("__kept"))
    later = (F.coalesce(F.col("doc_id"), F.lit(EARLIEST)) > F.col("__first")) & (F.col("__n_words") >= window)
    return keyed.join(found, "__digest").withColumn("__n_removed", F.when(later, F.col("__n_words")).otherwise(F.col("__n_removed"))).withColumn("__kept", F.when(later, F.lit("") if texts else F.sha2(F.lit(b""), 256)).otherwise(F.col("__kept")))


def digest(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row."""
    return results(documents.select("doc_id", "text"), window, False).select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept").alias("kept_sha256"))


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents with their kept words, joined by one space, as text (null stays null), n_words and n_removed."""
    out = results(documents, window, True)
    kept = F.when(F.col("text").isNotNull(), F.col("__kept")).alias("text")
    return with_result(out, F.struct(kept, F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed")), ["text", "n_words", "n_removed"]).drop("__digest", "__first", "__n_words", "__n_removed", "__kept")


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), g AS (
  SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g
), x AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN coalesce(list_aggregate(w, 'string_agg', ' '), '') ELSE coalesce((SELECT string_agg(u.v, ' ' ORDER BY u.j) FROM (SELECT unnest(w) AS v, unnest(range(1, len(w) + 1)) AS j) u WHERE NOT list_contains(gone, u.j)), '') END) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""
