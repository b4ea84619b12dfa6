"""Token ids in fixed-width bit packing.

A text's ids come from a tokenizer of the `tokenizers` library, an end id closes each document, and
files hold documents in ascending doc_id order. A file:

    magic "BPK1" | bits u32 | docs u64 | ids u64 | ids per block u64 | blocks u64
    doc_ids i64 x docs | known u8 x docs (0: the doc_id is null) | ends u64 x docs (ids up to and with each document)
    block offsets u64 x (blocks + 1) | payload

Every id takes the fewest bits that hold the largest id of the vocabulary; a block starts at a byte,
so a block is unpacked alone (numpy) and any document is found through `ends` and the block offsets.

Words part at ASCII white space and before the signs that end them, at which this tokenizer's pieces
part too; a word's ids are looked up once in `SLICE` characters of text and remembered by the worker
(`CACHE` words, then anew), new words go to the library many at a time. Documents are dealt to
buckets by quantiles of doc_id, each bucket sorted on its own; a bucket is one file or, past `file_ids`
ids, several, so a doc_id that very many rows share is no larger task in memory. A file is written
under a name of its own and moved to a name that its bucket determines, so a task that runs twice
leaves one file.

Defined results: null reads as empty (its ids are the end id alone); null doc_ids come first; rows of
one doc_id are in order of their ids; an empty table has no files and no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import partitions, shared_dir, slices, text_batches

MAGIC = b"BPK1"
BLOCK_IDS = 1 << 16
CACHE = 300_000
SLICE = 2_000_000
#: Signs that end a word after a letter: a piece of their own.
TAIL = r"([A-Za-z])([!-/:-@\[-`{-~]+)([\t-\r ]|$)"


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), dtype=np.uint8)
    full[:, :bits] = planes
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


def to_file(docs: list[tuple[int | None, np.ndarray]], bits: int, block: int = BLOCK_IDS) -> bytes:
    ends = np.cumsum([len(ids) for _, ids in docs]).astype("<u8")
    ids = np.concatenate([ids for _, ids in docs]) if docs else np.zeros(0, dtype="<u4")
    blocks = [pack(ids[at : at + block], bits) for at in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = MAGIC + np.array([bits], "<u4").tobytes() + np.array([len(docs), len(ids), block, len(blocks)], "<u8").tobytes()
    names = np.array([d or 0 for d, _ in docs], dtype="<i8").tobytes() + np.array([d is not None for d, _ in docs], dtype=np.uint8).tobytes()
    return b"".join([head, names, ends.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads a file's parts through seek and read: the head, the tables, and blocks as they are asked for."""

    def __init__(self, source) -> None:
        self.source = source
        if source.read(4) != MAGIC:
            raise ValueError("not a token file")
        self.bits = int(np.frombuffer(source.read(4), "<u4")[0])
        docs, self.ids, self.block, blocks = (int(x) for x in np.frombuffer(source.read(32), "<u8"))
        names = np.frombuffer(source.read(8 * docs), "<i8").tolist()
        known = source.read(docs)
        self.doc_ids = [d if k else None for d, k in zip(names, known, strict=True)]
        self.ends = np.frombuffer(source.read(8 * docs), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.base = 40 + 8 * docs + docs + 8 * docs + 8 * (blocks + 1)

    def read_block(self, k: int) -> np.ndarray:
        self.source.seek(self.base + int(self.offsets[k]))
        return unpack(self.source.read(int(self.offsets[k + 1] - self.offsets[k])), min(self.block, self.ids - k * self.block), self.bits)

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document, from its blocks alone."""
        low, high = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        first = low // self.block
        parts = [self.read_block(k) for k in range(first, (high - 1) // self.block + 1)]
        return np.concatenate(parts)[low - first * self.block : high - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, ids of the file before it, ids; in order, holding one document and one block."""
        rest, at, k = np.zeros(0, dtype="<u4"), 0, 0
        for d, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            parts, held = [rest], len(rest)
            while held < end - at:
                parts.append(self.read_block(k))
                held += len(parts[-1])
                k += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield d, at, rest[: end - at]
            rest, at = rest[end - at :], end


class Encoder:
    """A tokenizer whose pieces never cross ASCII white space, with the ids of words remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}

    @property
    def bits(self) -> int:
        return max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())

    def library(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def learn(self, words: list[str]) -> None:
        """The ids of words not yet known. A word of letters is one piece: ASCII ones go to the library's model, others are encoded many as one text."""
        letters, others, pieces = [], [], self.tokenizer.model.tokenize
        for w in words:
            if not w.isalpha():
                others.append(w)
            elif w.isascii():
                self.known[w] = np.array([x.id for x in pieces(w.lower())], dtype="<u4").tobytes()
            else:
                letters.append(w)
        for at in range(0, len(letters), 512):
            part = letters[at : at + 512]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)  # the batch call keeps no word numbers
            which = np.array([-1 if x is None else x for x in e.word_ids], dtype=np.int64)
            ends = [*(4 * (np.flatnonzero(np.diff(which)) + 1)).tolist(), 4 * len(which)]
            if len(ends) == len(part) and which.min(initial=0) >= 0:  # a piece is a word, as numbers of pieces only rise
                ids = np.array(e.ids, dtype="<u4").tobytes()
                self.known.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=True))
            else:  # a word has other pieces than its letters; each on its own
                others += part
        for w, e in zip(others, self.library(others), strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None], end: int) -> Iterator[np.ndarray]:
        for part in slices(texts, SLICE):
            yield from self.slice(part, np.array([end], dtype="<u4"))

    def slice(self, texts: list[str], last: np.ndarray) -> Iterator[np.ndarray]:
        """A slice's distinct words are looked up once; numpy lays their ids out for all places of the words."""
        special = {i for i, t in enumerate(texts) if "<|" in t}  # such a text goes to the library whole
        held = pa.array(["" if i in special else t for i, t in enumerate(texts)], pa.large_string())
        # ASCII lowers here as the tokenizer does
        held = pc.if_else(pc.string_is_ascii(held), pc.ascii_lower(held), held)
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(held, TAIL, r"\1 \2\3"))
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE:
            self.known = {"": b""}
        self.learn([w for w in own if w not in self.known])
        ids = [self.known[w] for w in own]
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = coded.indices.to_numpy(zero_copy_only=False)
        per = lengths[place]
        until = np.concatenate([[0], np.cumsum(per)])
        first = (np.cumsum(lengths) - lengths)[place] - until[:-1]
        ids = flat[np.repeat(first, per) + np.arange(until[-1])]
        ends = until[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            yield np.concatenate([np.array(self.library([texts[i]])[0].ids, dtype="<u4") if i in special else ids[a:b], last])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def quantiles(documents: DataFrame, bucket_docs: int) -> list[int]:
    """Bounds of doc_id that part the rows into buckets of about so many."""
    n = documents.count()
    k = -(-n // bucket_docs)
    if k <= 1:
        return []
    # the sketch's accuracy is a tenth of a bucket
    bounds = documents.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 10 * k).alias("b")).first()["b"]
    return sorted(set(bounds or []))


def write(documents: DataFrame, tokenizer: str, end_id: int, folder: str, bucket_docs: int = 2000, file_ids: int = 2_000_000) -> list[tuple]:
    """Writes the documents' ids; returns (path, docs, ids) for each file, in order."""
    bounds = quantiles(documents, bucket_docs)
    spark = documents.sparkSession
    text_batches(spark)
    bits = encoder(tokenizer).bits

    @F.pandas_udf("binary")
    def packed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(tokenizer)
        for texts in it:
            yield pd.Series([len(ids).to_bytes(8, "little") + pack(ids, bits) for ids in e.encode(texts.tolist(), end_id)], dtype=object)

    @F.pandas_udf("int")
    def bucket(doc_ids: pd.Series) -> pd.Series:
        known = doc_ids.notna().to_numpy()
        return pd.Series(np.where(known, np.searchsorted(np.array(bounds, dtype=np.int64), doc_ids.fillna(0).to_numpy(dtype=np.int64), side="left"), 0).astype("int32"))

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        own, held, now, part = [], 0, None, 0

        def put() -> pa.RecordBatch:
            path = f"{root}/{now:08d}-{part:04d}.tokens"
            with store.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}") as f:
                f.write(to_file(own, bits))
            store.move(draft, path)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32()), "part": pa.array([part], pa.int32()), "path": [path], "docs": pa.array([len(own)], pa.int64()), "ids": pa.array([held], pa.int64())})

        for batch in it:
            for b, d, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = int.from_bytes(data[:8], "little")
                if own and (b != now or held + n > file_ids):
                    yield put()
                    part = part + 1 if b == now else 0
                    own, held = [], 0
                now = b
                own.append((d, unpack(data[8:], n, bits)))
                held += n
        if own:
            yield put()

    dealt = documents.select(bucket("doc_id").alias("bucket"), "doc_id", packed("text").alias("ids")).repartition(min(len(bounds) + 1, 4 * partitions(spark)), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    files = dealt.mapInArrow(save, "bucket int, part int, path string, docs long, ids long").collect()  # a row for each file
    return [(r["path"], r["docs"], r["ids"]) for r in sorted(files)]


def read(spark, folder: str, files: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the files alone."""
    before = np.concatenate([[0], np.cumsum([n for _, _, n in files])]).tolist()
    table = spark.createDataFrame([(p, int(s)) for (p, _, _), s in zip(files, before, strict=False)], "path string, start long").repartition(max(1, min(len(files), 4 * partitions(spark))))

    def load(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in it:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                with store.open_input_file(path) as f:
                    rows = [(d, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in TokenFile(f).documents()]
                yield pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "start": [r[1] for r in rows], "n_tokens": [r[2] for r in rows], "ids_crc32": [r[3] for r in rows]})

    return table.mapInPandas(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids to a folder of the shared one and reads them back."""
    folder = folder or f"{shared_dir(documents.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(documents.sparkSession, folder, write(documents.select("doc_id", "text"), tokenizer, end_id, folder))
