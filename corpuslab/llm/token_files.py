"""Token ids in binary files of patched frame-of-reference blocks.

A file image holds whole documents: a header, the documents' lengths, an index of block
starts, and blocks of 256 ids. A block stores its smallest id, the differences to it packed
at the width that ``FITTING`` of them fit, and the high bits of the others as exceptions.

Images are written and read through Spark's Parquet writer and reader, one per row, so that
commits survive lost executors and any file system that Spark knows will do.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.batches import slices
from corpuslab.session import scratch_path

# File format.
MAGIC = b"PFR1"
BLOCK = 256
FITTING = 0.9
IMAGE_IDS = 1 << 20  # ids after which a new image begins; documents stay whole
_HEADER = "<4sIQI"

KNOWN_PIECES = 1_000_000
TOGETHER = 4096  # new pieces that are encoded in one call
RUN = 64  # words in each text of such a call
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_ENDINGS = ".,!?;:"
_HELD = "corpuslab_worker_encoder"


class Encoder:
    """Encodes whole texts with a tokenizers file, remembering the ids of pieces.

    The tokenizer (byte-level BPE with its usual split) always begins a new unit where a run
    of white space begins, and at a mark after a letter, so text between two such places
    encodes on its own. Pieces not seen before are encoded together.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold one of these are encoded whole: the library cuts them there
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # whether a token begins with a space, which this encoding writes as U+0120
        vocabulary = self.tokenizer.get_vocab()
        self.spacing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spacing[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True
        self.end = np.array([end_id], "<u4").tobytes()
        self.marks = {c: self._ids(c) for c in _ENDINGS}
        self._forget()

    def _forget(self) -> None:
        # a piece stands for itself after one space, or after a line break that it begins with;
        # None: another split is needed there
        self.spaced: dict[str, bytes | None] = {"": None, "\n": None}
        self.exact: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        # the same ids as from encode; offsets, which nobody asks for, are not worked out
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _exact(self, chunk: str) -> bytes:
        found = self.exact.get(chunk)
        if found is None:
            found = self.exact[chunk] = self._ids(chunk)
        return found

    def _learn(self, pieces: set[str]) -> None:
        known, plain, others = self.spaced, [], []
        marked = [p for p in pieces if len(p) > 1 and p[-1] in _ENDINGS and p[-2].isalpha()]
        stems = {p[:-1] for p in marked}.difference(known) | pieces.difference(marked)
        for p in stems:
            if p.isalpha():
                plain.append(p)
            elif p[-1].isspace():
                known[p] = None
            else:
                others.append(p)
        for low in range(0, len(plain), TOGETHER):
            group = plain[low:low + TOGETHER]
            raw = np.concatenate(self._encoded([" " + " ".join(group[i:i + RUN]) for i in range(0, len(group), RUN)]))
            begins = np.flatnonzero(self.spacing[raw])  # a space comes in once a word, as its first byte
            if len(begins) == len(group):
                known.update(zip(group, _cut(raw, np.append(begins, len(raw)).tolist())))
            else:
                others += group
        for low in range(0, len(others), TOGETHER):
            group = others[low:low + TOGETHER]
            found = self._encoded([p if p[0] == "\n" else " " + p for p in group])
            known.update((p, ids.tobytes()) for p, ids in zip(group, found))
        for p in marked:
            known[p] = known[p[:-1]] + self.marks[p[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian 32-bit numbers."""
        if len(self.spaced) + len(self.exact) > KNOWN_PIECES:
            self._forget()
        bodies = [t.rstrip(" \n\t\r") for t in texts]
        split = [b.replace("\n", " \n").split(" ") for b in bodies]
        plain = [p[1:] for t, p in zip(texts, split) if not any(a in t for a in self.added)]
        new = set(chain.from_iterable(plain)).difference(self.spaced)
        if new:
            self._learn(new)
        known, found = self.spaced.__getitem__, []
        for text, body, pieces in zip(texts, bodies, split):
            if not text:
                found.append(self.end)
                continue
            if any(a in text for a in self.added):
                found.append(self._ids(text) + self.end)
                continue
            tail = text[len(body):]
            try:
                ids = (self._exact(pieces[0]) if pieces[0] else b"") + b"".join(map(known, pieces[1:]))
                if pieces[0] and pieces[0][-1].isspace():
                    raise TypeError
                ids += self._exact(tail) if tail else b""
            except TypeError:  # runs of white space
                ids = b"".join(map(self._exact, _CHUNK.findall(text)))
            found.append(ids + self.end)
        return found


def worker_encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this worker process, so that the pieces it knows outlive a task.

    Functions that travel whole bring globals of their own to every task; the encoder is held
    by a module of the process instead. One is held at a time, with ``KNOWN_PIECES`` at most.
    """
    file = os.stat(path)
    held = sys.modules.setdefault(_HELD, ModuleType(_HELD))
    own = path, end_id, file.st_mtime_ns, file.st_size
    if getattr(held, "own", None) != own:
        held.encoder, held.own = Encoder(path, end_id), own
    return held.encoder


def _cut(ids: np.ndarray, edges: list[int]) -> Iterator[bytes]:
    """The bytes of 32-bit ids between each edge and the next."""
    raw = ids.tobytes()
    return (raw[4 * a:4 * b] for a, b in pairwise(edges))


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 256 values below 2**width as rows of 4 * width 64-bit words."""
    lanes = values.reshape(-1, 64).astype(np.uint64)
    out = np.zeros((len(lanes), width), np.uint64)
    for j in range(64):
        k, shift = divmod(j * width, 64)
        out[:, k] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, k + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    lanes = packed.reshape(-1, width)
    out = np.empty((len(lanes), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        k, shift = divmod(j * width, 64)
        value = lanes[:, k] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (lanes[:, k + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.reshape(-1, BLOCK)


def write_image(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """File image of the ids of some documents, given their lengths."""
    n_blocks = -(-len(ids) // BLOCK)
    filled = np.zeros(n_blocks * BLOCK, np.uint32)
    filled[:len(ids)] = ids
    if len(ids) % BLOCK:
        filled[len(ids):] = ids[-1]
    blocks = filled.reshape(-1, BLOCK)
    least = blocks.min(axis=1, initial=0xFFFFFFFF)
    over = blocks - least[:, None]
    place = max(int(np.ceil(FITTING * BLOCK)) - 1, 0)
    fitting = np.partition(over, place, axis=1)[:, place] if n_blocks else np.zeros(0, np.uint32)
    width = np.zeros(n_blocks, np.int64)
    positive = fitting > 0
    width[positive] = np.floor(np.log2(fitting[positive].astype(np.float64))).astype(np.int64) + 1
    high = over >> width[:, None].astype(np.uint32)
    n_patched = (high > 0).sum(axis=1)
    size = 8 + 32 * width + 5 * n_patched
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    body = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        head = np.zeros((len(at), 8), np.uint8)
        head[:, :4] = least[at].astype("<u4").view(np.uint8).reshape(-1, 4)
        head[:, 4] = w
        head[:, 5:7] = n_patched[at].astype("<u2").view(np.uint8).reshape(-1, 2)
        if w:
            low = over[at] & np.uint32((1 << int(w)) - 1)
            head = np.concatenate([head, _pack(low, int(w)).astype("<u8").view(np.uint8).reshape(len(at), -1)], axis=1)
        body[start[at][:, None] + np.arange(head.shape[1])] = head
    where, spot = np.nonzero(high)
    if len(where):
        order = np.arange(len(where)) - np.searchsorted(where, where)
        place = start[where] + 8 + 32 * width[where]
        body[place + order] = spot
        wide = high[where, spot].astype("<u4").view(np.uint8).reshape(-1, 4)
        body[(place + n_patched[where] + 4 * order)[:, None] + np.arange(4)] = wide
    return b"".join([struct.pack(_HEADER, MAGIC, len(lengths), len(ids), n_blocks), lengths.astype("<u4").tobytes(),
                     start.astype("<u8").tobytes(), body.tobytes()])


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a file image."""
    magic, n_docs, n_ids, n_blocks = struct.unpack_from(_HEADER, image)
    if magic != MAGIC:
        raise ValueError("not a token file image")
    at = struct.calcsize(_HEADER)
    lengths = np.frombuffer(image, "<u4", n_docs, at)
    at += 4 * n_docs
    start = np.frombuffer(image, "<u8", n_blocks + 1, at).astype(np.int64)
    body = np.frombuffer(image, np.uint8, int(start[-1]), at + 8 * (n_blocks + 1))
    head = body[start[:-1][:, None] + np.arange(8)]
    least = head[:, :4].copy().view("<u4").reshape(-1)
    width = head[:, 4].astype(np.int64)
    n_patched = head[:, 5:7].copy().view("<u2").reshape(-1).astype(np.int64)
    over = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = body[(start[:-1][rows] + 8)[:, None] + np.arange(32 * w)].copy().view("<u8")
        over[rows] = _unpack(packed, int(w))
    where = np.repeat(np.arange(n_blocks), n_patched)
    if len(where):
        order = np.arange(len(where)) - np.searchsorted(where, where)
        place = start[:-1][where] + 8 + 32 * width[where]
        spot = body[place + order]
        high = body[(place + n_patched[where] + 4 * order)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        over[where, spot] |= high << width[where].astype(np.uint32)
    return (over + least[:, None]).reshape(-1)[:n_ids], lengths


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id: str = "doc_id", text: str = "text",
          order: Sequence[Column] = ()) -> None:
    """Encode every text, append ``end_id``, and write images to ``path`` in ``order``, by default ascending id.

    Null ids come first, equal ids lie together (ordered by a hash of their text), null text
    counts as empty and gives the end id alone. Repeated rows are written as often as they
    occur; an empty table gives no images. Other columns are not written.
    """
    keys = [c.alias(f"order_{k}") for k, c in enumerate(order)]
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keys)
    by = [F.col(f"order_{k}") for k in range(len(keys))] or [F.col("id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("id", "text")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_file, end_id)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        kept: list[bytes] = []
        n = 0

        def image() -> pa.RecordBatch:
            lengths = np.array([len(b) // 4 for b in kept], np.int64)
            data = write_image(np.frombuffer(b"".join(kept), "<u4"), lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([number]), pa.array([before]), pa.array([n]),
                 pa.array([ids], pa.list_(kind)), pa.array([data], pa.binary())],
                names=["part", "number", "before", "n_ids", "ids", "image"])

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("id").type
            for texts in slices(batch.column("text")):
                run_of = batch.slice(texts.first, len(texts))
                encoded_run = encoder.encode(run_of.column("text").to_pylist())
                for doc_id, encoded in zip(run_of.column("id").to_pylist(), encoded_run):
                    ids.append(doc_id)
                    kept.append(encoded)
                    n += len(encoded) // 4
                    if n >= IMAGE_IDS:
                        yield image()
                        number, before, n, ids, kept = number + 1, before + n, 0, [], []
        if kept:
            yield image()

    ordered.mapInArrow(run, f"part long, number long, before long, n_ids long, ids array<{id_type}>, image binary"
                       ).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder with ``start``: ids of all documents before the image."""
    images = spark.read.parquet(path)
    # one row per task that wrote, so the running sum and the broadcast are small
    parts = images.groupBy("part").agg(F.sum("n_ids").alias("total")).withColumn(
        "first", F.sum("total").over(Window.orderBy("part")) - F.col("total"))
    return images.join(F.broadcast(parts.select("part", "first")), "part").select(
        (F.col("first") + F.col("before")).alias("start"), "ids", "image")


def digests(images: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per document, from the decoded images: id, start, n_tokens and the CRC-32 of its ids."""
    id_type = images.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, owner, image in zip(*(batch.column(c) for c in ("start", "ids", "image"))):
                ids, lengths = read_image(image.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [owner.values, pa.array(begins + start.as_py()), pa.array(lengths.astype(np.int64)),
                     pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return images.select("start", "ids", "image").mapInArrow(
        run, f"id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id)


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int, id: str = "doc_id", text: str = "text",
               order: Sequence[Column] = ()) -> DataFrame:
    """Write token files to the shared folder and give the digests of what is read back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer_file, end_id, id, text, order)
    return digests(read(docs.sparkSession, path), id)
