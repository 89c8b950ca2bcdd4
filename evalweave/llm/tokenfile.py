"""Token ids in seekable binary files.

A file is a run of independent zstandard frames, each with the ids (little-endian
unsigned 32-bit) of a few whole documents; then a skippable frame with the document
index; then a trailing seek table in the public seekable format: compressed size, size
and checksum of every frame. A reader opens the end, and decompresses only the
frames of the documents it wants.

Documents are range-partitioned by id, so file k holds smaller ids than file k + 1.
Each task streams its partition into a file of its own with a fresh name and returns
one manifest row; a lost or repeated task leaves at most a file no manifest names.

Nulls: a null text is empty (its ids are the end id alone); null ids sort first.
Repeated ids keep one entry each, ordered by text hash. An empty table gives an empty
manifest.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.llm.common import pinned, small_batches
from evalweave.session import scratch_path

#: Fixed values of the public seekable format.
SEEK_TABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Skippable frame of the document index.
INDEX_MAGIC = 0x184D2A50
FRAME_TOKENS = 1 << 16
END_ID = 2
#: Words an encoder remembers, twice: when full, the older half goes. About 200 bytes each.
REMEMBERED = 1 << 19
#: Letters beyond these may be lower-cased in other ways than Python does.
MARKS = ".,;:!?*$#%&"
UNUSUAL = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]").search
MANIFEST = "part int, path string, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint, n_bytes bigint"


class Encoder:
    """Ids of whole texts as bytes, with the tokenizers library.

    The tokenizer's splitter never joins across blanks, and parts a run of letters from
    the punctuation behind it; so a text is the sequence of its words, and words and their
    parts are remembered. ``tests/llm`` holds it against whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {"": b""}, {}
        # letters that composing and lower-casing treat one by one, and marks behind them, are encoded
        # apart: the ends of words tell which ids are whose
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not met lately."""
        learnt, parts, new, odd, known = {}, [], set(), [], self.known
        for w in words:
            ids = self.older.get(w)
            if ids is not None:
                learnt[w] = ids
                continue
            letters = w.rstrip(MARKS)
            if letters.isalpha() and (letters.isascii() or not UNUSUAL(letters)):
                if len(letters) < len(w):
                    marks = w[len(letters):]
                    parts.append((w, letters, marks))
                    if marks not in known:
                        new.add(marks)
                if letters not in known:
                    new.add(letters)
            else:
                odd.append(w)
        for x in [x for x in new if x in self.older]:
            learnt[x] = self.older[x]
        learnt |= self._encode([x.lower() for x in new if x not in learnt], odd)
        for x in new:
            if x not in learnt:
                learnt[x] = learnt[x.lower()]
        for w, letters, marks in parts:
            learnt[w] = (learnt.get(letters) or known[letters]) + (learnt.get(marks) or known[marks])
        if len(known) > REMEMBERED:
            self.known, self.older = {"": b""}, known
        self.known.update((w, x) for w, x in learnt.items() if len(w) <= 64)
        return learnt

    def _encode(self, plain: list[str], odd: list[str]) -> dict[str, bytes]:
        """Plain parts are one word each to the tokenizer, so one call serves all of them;
        a word's last token is marked as such."""
        out = {}
        if plain:
            whole = self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0]
            ids = np.array(whole.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the tokenizer parts words elsewhere than expected")
            data, starts = ids.tobytes(), [0, *(4 * ends).tolist()]
            out = {w: data[a:b] for w, a, b in zip(plain, starts, starts[1:])}
        if odd:
            found = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
            out |= {w: struct.pack(f"<{len(e)}I", *e.ids) for w, e in zip(odd, found)}
        return out

    def words(self, text: str | None) -> list[str]:
        """Lower-cased first, as the tokenizer does, so that fewer words are new."""
        text = text or ""
        text = text.lower() if text.isascii() or not UNUSUAL(text) else text
        return text.replace("\n", " ").split(" ")

    def many(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; what is new to all of them is learnt at once."""
        words = [self.words(t) for t in texts]
        # each different word is looked up once in what is remembered, all others in these few
        every = set().union(*words)
        known = self.known
        here = {w: known[w] for w in every if w in known}
        if len(here) < len(every):
            here |= self._learn(every.difference(here))
        return [b"".join(map(here.__getitem__, w)) for w in words]

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a worker, so that what it remembers outlives a task."""
    return Encoder(path)


class Writer:
    """Writes one file, holding one frame at a time."""

    def __init__(self, out):
        self.out, self.size, self.codec = out, 0, zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.in_frame: list[int] = []
        self.pieces: list[bytes] = []
        self.held = self.opened = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.pieces.append(ids)
        self.held += len(ids)
        if self.held >= 4 * FRAME_TOKENS:
            self.flush()

    def flush(self) -> None:
        if self.pieces:
            raw = b"".join(self.pieces)
            packed = self.codec.compress(raw)
            self._put(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.in_frame.append(len(self.docs) - self.opened)
            self.opened, self.pieces, self.held = len(self.docs), [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.flush()
        valid = np.array([d is not None for d, _ in self.docs], np.uint8)
        body = self.codec.compress(b"".join([
            np.array(self.in_frame, "<u4").tobytes(), np.array([d or 0 for d, _ in self.docs], "<i8").tobytes(),
            np.array([n for _, n in self.docs], "<u4").tobytes(), valid.tobytes()]))
        head = struct.pack("<II", len(self.docs), len(self.frames))
        self._put(struct.pack("<II", INDEX_MAGIC, len(head) + len(body)) + head + body)
        index = len(head) + len(body) + 8
        table = b"".join(struct.pack("<III", *f) for f in [*self.frames, (index, 0, 0)])
        table += struct.pack("<IBI", len(self.frames) + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._put(struct.pack("<II", SEEK_TABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads one file; ``documents`` decompresses only the frames it needs."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, flag, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * count)
        frames = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.ends = np.cumsum(frames[:, 0])
        self.frames, self.codec = frames[:-1], zstandard.ZstdDecompressor()
        source.seek(int(self.ends[-1] - frames[-1, 0]))
        block = source.read(int(frames[-1, 0]))
        n_docs, n_frames = struct.unpack("<II", block[8:16])
        body = io.BytesIO(self.codec.decompress(block[16:]))
        self.in_frame = np.frombuffer(body.read(4 * n_frames), "<u4").astype(np.int64)
        self.ids = np.frombuffer(body.read(8 * n_docs), "<i8")
        self.tokens = np.frombuffer(body.read(4 * n_docs), "<u4").astype(np.int64)
        self.valid = np.frombuffer(body.read(n_docs), np.uint8).astype(bool)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = self.frames[k]
        self.source.seek(int(self.ends[k] - packed))
        raw = self.codec.decompress(self.source.read(int(packed)), max_output_size=int(size))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Sequence[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, tokens of the file before it, ids) in file order."""
        starts = np.cumsum(self.tokens) - self.tokens
        mask = np.ones(len(self.ids), bool) if wanted is None else np.isin(self.ids, list(wanted)) & self.valid
        first = 0
        for k, n in enumerate(self.in_frame.tolist()):
            here = np.flatnonzero(mask[first:first + n]) + first
            if len(here):
                raw, base = self.frame(k), starts[first]
                for i in here.tolist():
                    lo = 4 * int(starts[i] - base)
                    yield (int(self.ids[i]) if self.valid[i] else None, int(starts[i]), raw[lo:lo + 4 * int(self.tokens[i])])
            first += n


def filesystem(uri: str):
    """Any store that Arrow knows; a plain path is local (or mounted) storage."""
    return arrow_fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (arrow_fs.LocalFileSystem(), uri)


def _write(folder: str, open_encoder: Callable[[], Callable[[Iterable[str | None]], list[bytes]]], end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, writer = open_encoder(), struct.pack("<I", end_id), None
        store, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            for lo in range(0, len(batch), 64):
                some = batch.iloc[lo:lo + 64]
                for doc_id, ids in zip(some["doc_id"], encode(some["text"])):
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        writer = Writer(store.open_output_stream(f"{root}/{name}", compression=None))
                    writer.add(None if pd.isna(doc_id) else int(doc_id), ids + end)
        if writer is not None:
            writer.close()
            writer.out.close()
            ids = [d for d, _ in writer.docs if d is not None]
            yield pd.DataFrame({
                "part": [part], "path": [f"{folder.rstrip('/')}/{name}"], "first_id": pd.array([min(ids, default=None)], "Int64"),
                "last_id": pd.array([max(ids, default=None)], "Int64"), "n_docs": [len(writer.docs)],
                "n_tokens": [sum(n for _, n in writer.docs)], "n_bytes": [writer.size]})
    return run


def write(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
          end_id: int = END_ID) -> DataFrame:
    """Encode and write; returns the manifest, one row per file, in id order."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would round large nullable integers
    return pinned(rows.mapInPandas(_write(folder, lambda: encoder(tokenizer).many, end_id), MANIFEST), "manifest")


def _read(wanted: Sequence[int] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, uri, start in zip(batch["part"], batch["path"], batch["start"]):
                store, path = filesystem(uri)
                with store.open_input_file(path) as source:
                    out = []
                    for doc_id, before, ids in Reader(source, source.size()).documents(wanted):
                        out.append((part, doc_id, int(start) + before, ids))
                        if len(out) == 512:
                            yield _frame(out)
                            out = []
                    if out:
                        yield _frame(out)
    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    part, doc_id, start, ids = zip(*rows)
    return pd.DataFrame({"part": part, "doc_id": pd.array(doc_id, "Int64"), "start": start,
                         "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "crc": [zlib.crc32(x) for x in ids]})


def read(manifest: DataFrame, wanted: Sequence[int] | None = None) -> DataFrame:
    """Documents of the files: doc_id, start (tokens of all documents before it), n_tokens,
    ids (bytes) and their crc32. ``wanted`` ids prune files, then frames."""
    # one row per file, as many as there were partitions
    placed = manifest.withColumn("start", F.coalesce(
        F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if wanted is not None:
        hits = [(F.col("first_id") <= w) & (F.col("last_id") >= w) for w in wanted]
        placed = placed.where(F.array_contains(F.array(*hits), True)) if hits else placed.limit(0)
    # a task for each file: the rows are tiny, so adaptive execution would merge them all
    files = placed.select("part", "path", "start").repartitionByRange(max(1, placed.count()), "part")
    return files.mapInPandas(_read(wanted), "part int, doc_id bigint, start bigint, n_tokens bigint, ids binary, crc bigint")


def encode_and_read(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    manifest = write(docs, scratch_path(docs.sparkSession, "token-files"), tokenizer, doc_id, text)
    return read(manifest)
