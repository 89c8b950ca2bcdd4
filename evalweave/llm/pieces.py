"""SentencePiece encoding and decoding, with giant documents encoded in parallel.

A document up to ``CHUNK`` characters is encoded in its own row. A longer one is cut
into chunks at fixed places, wherever words fall, and encoded by a max-plus scan:

1. The state at a boundary is the piece that covers the character before it. Each chunk
   yields its transfer matrix: the best weight from every entry state to every exit
   state. Only the characters up to the first and from the last word start matter,
   because no piece runs across the start of a word.
2. Matrices combine associatively, in groups of 256 and then per document; going
   down again gives the entry and exit state of every chunk.
3. Each chunk is then backtraced on its own.

Weights: for a unigram model a piece's score. A BPE segmentation is the only one in
which every two neighbours are what BPE makes of their concatenation, so there a step
weighs 0 if its pair passes that test and minus infinity if not. The ids therefore are
those of the library for the whole text.

Nulls: null and empty texts give one row without ids; null ids are carried. Repeated rows
are encoded each. Decoding gives back the text, with U+2581 read as a blank, which is
how the format stores one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import pinned, small_batches

CHUNK = 1 << 15
GROUP = 256
BLANK = "▁"
UNIGRAM, BPE = 1, 2
IDS = "doc_id bigint, chunk int, n_chunks int, ids array<int>, round_trip boolean"
NEVER = float("-inf")


class Model:
    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        data = proto if proto is not None else open(path, "rb").read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(data)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = spec.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation and with a leading blank are supported")
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind}")
        self.names = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == 2)
        self.unknown_score = min(self.score.values()) - 10
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.longest = max(map(len, self.ids))
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece runs across the start of a word")
        self.fits = lru_cache(1 << 18)(self._fits)

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def _fits(self, before: str, piece: str) -> bool:
        return self.kind == UNIGRAM or self.merged(before + piece) == ([before, piece] if before else [piece])

    def weight(self, piece: str) -> float:
        return 0.0 if self.kind == BPE else self.score.get(piece, self.unknown_score)

    def is_piece(self, piece: str) -> bool:
        return piece in self.score or len(piece) == 1

    def codes(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def between(self, words: str) -> list[int]:
        """Ids of a stretch from one word start to another; it begins with a blank."""
        if not words:
            return []
        if words == BLANK:
            return self.codes(words)
        return self.library.encode(words[1:].replace(BLANK, " "))

    def surface(self, ids: list[int]) -> str:
        """What the ids stand for, blanks as stored."""
        out, raw = [], bytearray()
        for i in ids:
            name = self.names[i]
            if self.bytes and len(name) == 6 and name.startswith("<0x"):
                raw.append(int(name[3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(name)
        return "".join(out) + raw.decode("utf-8", "replace")


@lru_cache(4)
def load(path: str) -> Model:
    return Model(path)


def stored(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


def cut(text: str, longest: int, chunk: int) -> list[tuple[str, str, str]]:
    """(context before, chunk, context after) of a stored text. The last chunk is never
    shorter than the others, so no piece spans a whole chunk."""
    n = max(1, len(text) // chunk)
    ends = [k * chunk for k in range(n)] + [len(text)]
    return [(text[max(0, a - longest):a], text[a:b], text[b:b + longest]) for a, b in zip(ends, ends[1:])]


class Chunk:
    """One chunk with its context; places count from the chunk's start.

    A state is (start, end) of the piece over the character before a boundary,
    counted from that boundary; (0, 0) is the beginning of the document.
    """

    def __init__(self, model: Model, before: str, text: str, after: str):
        self.model, self.lead, self.size = model, len(before), len(text)
        self.all, self.first, self.last = before + text + after, not before, not after
        starts = [p for p in range(0, self.size + 1) if self._word_start(p)]
        self.head = 0 if self.first else next((p for p in starts), None)
        self.tail = self.size if self.last else next((p for p in reversed(starts)), None)
        if self.tail is None and self.first:
            self.tail = 0
        if self.head is None and self.last:
            self.head = self.size

    def _word_start(self, p: int) -> bool:
        at = self.lead + p
        return 0 < at < len(self.all) and self.all[at] == BLANK and self.all[at - 1] != BLANK

    def piece(self, a: int, b: int) -> str:
        return self.all[self.lead + a:self.lead + b]

    def states(self, at: int) -> list[tuple[int, int]]:
        """Pieces that cover the character before place ``at``."""
        m = self.model
        return [(a - at, b - at) for a in range(max(-self.lead, at - m.longest), at)
                for b in range(at, min(a + m.longest, len(self.all) - self.lead) + 1) if m.is_piece(self.piece(a, b))]

    def paths(self, origin: tuple[int, int] | None, begin: int, stop: int, over: bool) -> dict:
        """Best (weight, previous) of every piece reachable from ``origin`` (a piece, or none
        at a word start); pieces end at ``stop``, or run over it if ``over``."""
        m = self.model
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        ending: dict[int, list] = {begin: [origin]}
        for a in range(begin, stop):
            for before in ending.pop(a, []):
                left = self.piece(*before) if before else ""
                base = best[before][0] if before in best else 0.0
                for b in range(a + 1, min(a + m.longest, len(self.all) - self.lead if over else stop) + 1):
                    name = self.piece(a, b)
                    if m.is_piece(name) and m.fits(left, name):
                        w, here = base + m.weight(name), (a, b)
                        if here not in best:
                            best[here] = (w, before)
                            ending.setdefault(b, []).append(here)
                        elif w > best[here][0]:
                            best[here] = (w, before)
        return best

    def _inner(self) -> float:
        if self.model.kind == BPE or self.head >= self.tail:
            return 0.0
        return sum(self.model.weight(self.model.names[i]) for i in self.model.between(self.piece(self.head, self.tail)))

    def matrix(self) -> list[tuple[int, int, int, int, float]]:
        """(entry start, entry end, exit start, exit end, weight), where a path exists."""
        entries = [(0, 0)] if self.first else self.states(0)
        out = []
        if self.head is None or self.tail is None:  # no word starts here
            for e in entries:
                found = self.paths(e, e[1], self.size, True)
                out += [(*e, a - self.size, b - self.size, w) for (a, b), (w, _) in found.items() if b >= self.size]
            return out
        heads = []
        for e in entries:
            if self.first or e[1] == self.head:
                heads.append((e, 0.0))
            elif e[1] < self.head:
                found = [w for (_, b), (w, _) in self.paths(e, e[1], self.head, False).items() if b == self.head]
                heads += [(e, max(found))] if found else []
        if self.last:
            tails = [((0, 0), 0.0)]
        elif self.tail == self.size:  # a word starts at the boundary: any piece that ends there
            found = self._closing()
            tails = [((a - self.size, 0), w) for (a, b), w in found]
        else:
            tails = [((a - self.size, b - self.size), w) for (a, b), (w, _) in
                     self.paths(None, self.tail, self.size, True).items() if b >= self.size]
        inner = self._inner()
        return [(*e, *x, w + inner + v) for e, w in heads for x, v in tails]

    def _closing(self) -> list:
        """The last piece before a word start that is the chunk's end; what it is makes no
        difference to what follows, so the inner ids decide it."""
        ids = self.model.between(self.piece(self.head, self.tail))
        last = len(self.model.surface(ids[-1:])) if ids and self.model.names[ids[-1]] in self.model.ids else 1
        return [((self.size - last, self.size), 0.0)]

    def trace(self, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
        """Ids of the pieces that start in this chunk, between the two states."""
        m, goal = self.model, (leave[0] + self.size, leave[1] + self.size)
        if self.head is None or self.tail is None:
            return self._walk(self.paths(entry, entry[1], self.size, True), goal, entry)
        ids = []
        if not self.first and entry[1] < self.head:
            found = self.paths(entry, entry[1], self.head, False)
            ids += self._walk(found, max((x for x in found if x[1] == self.head), key=lambda x: found[x][0]), entry)
        ids += m.between(self.piece(self.head, self.tail))
        if not self.last and self.tail < self.size:
            ids += self._walk(self.paths(None, self.tail, self.size, True), goal, None)
        return ids

    def _walk(self, found: dict, at: tuple, origin: tuple | None) -> list[int]:
        names = []
        while at is not None and at != origin:
            names.append(self.piece(*at))
            at = found[at][1]
        return [i for name in reversed(names) for i in self.model.codes(name)]


def product(left: dict, right: dict) -> dict:
    """Max-plus product of sparse matrices {(entry, exit): weight}."""
    by_entry: dict = {}
    for (e, x), w in right.items():
        by_entry.setdefault(e, []).append((x, w))
    out: dict = {}
    for (e, mid), w in left.items():
        for x, v in by_entry.get(mid, ()):
            if w + v > out.get((e, x), NEVER):
                out[e, x] = w + v
    return out


def route(matrices: list[dict], entry: tuple, leave: tuple | None) -> list[tuple]:
    """States at all boundaries of the best path from ``entry`` to ``leave`` (or any)."""
    ahead, steps = {entry: 0.0}, []
    for m in matrices:
        back, reach = {}, {}
        for (e, x), w in m.items():
            if e in ahead and ahead[e] + w > reach.get(x, NEVER):
                reach[x], back[x] = ahead[e] + w, e
        steps.append(back)
        ahead = reach
    states = [leave if leave is not None else max(ahead, key=lambda s: ahead[s])]
    for back in reversed(steps):
        states.append(back[states[-1]])
    return states[::-1]


def _to_dict(cells) -> dict:
    return {((a, b), (c, d)): w for a, b, c, d, w in (tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in cells)}


CELLS = "array<struct<a: int, b: int, c: int, d: int, w: double>>"


def _small(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            ids = model.library.encode(texts, num_threads=1) if texts else []
            back = model.library.decode(ids, num_threads=1) if texts else []
            same = [a == b.replace(BLANK, " ") if x else b == "" for a, b, x in zip(back, texts, ids)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "chunk": 0, "n_chunks": 1, "ids": ids, "round_trip": same})
    return run


def _split(path: str, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest = load(path).longest
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                parts = cut(stored(text), longest, chunk)
                for lo in range(0, len(parts), 64):
                    some = parts[lo:lo + 64]
                    yield pd.DataFrame({"row": row, "doc_id": pd.array([doc] * len(some), dtype="string").astype("Int64"), "chunk": range(lo, lo + len(some)), "n_chunks": len(parts),
                                        "before": [p[0] for p in some], "text": [p[1] for p in some], "after": [p[2] for p in some]})
    return run


def _matrices(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for batch in batches:
            cells = [Chunk(model, a, t, b).matrix() for a, t, b in zip(batch["before"], batch["text"], batch["after"])]
            yield pd.DataFrame({"row": batch["row"], "chunk": batch["chunk"], "cells": [
                [dict(zip("abcdw", x)) for x in c] for c in cells]})
    return run


def _combine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = None
    for cells in group.sort_values("chunk")["cells"]:
        m = _to_dict(cells)
        total = m if total is None else product(total, m)
    return pd.DataFrame({"row": [key[0]], "chunk": [key[1]], "cells": [
        [{"a": e[0], "b": e[1], "c": x[0], "d": x[1], "w": w} for (e, x), w in total.items()]]})


def _states(rows: pd.DataFrame, entry: tuple, leave: tuple | None) -> pd.DataFrame:
    rows = rows.sort_values("chunk")
    found = route([_to_dict(c) for c in rows["cells"]], entry, leave)
    return pd.DataFrame({"row": rows["row"], "chunk": rows["chunk"], "a": [s[0] for s in found[:-1]], "b": [s[1] for s in found[:-1]],
                         "c": [s[0] for s in found[1:]], "d": [s[1] for s in found[1:]]})


def _top(rows: pd.DataFrame) -> pd.DataFrame:
    return _states(rows, (0, 0), None)


def _within(rows: pd.DataFrame) -> pd.DataFrame:
    r = rows.iloc[0]
    return _states(rows, (r["a"], r["b"]), (r["c"], r["d"]))


def _trace(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for batch in batches:
            ids, same = [], []
            for r in batch.itertuples():
                part = Chunk(model, r.before, r.text, r.after)
                found = part.trace((r.a, r.b), (r.c, r.d))
                ids.append(found)
                same.append(model.surface(found) == part.piece(r.b, part.size + r.d))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "chunk": batch["chunk"], "n_chunks": batch["n_chunks"],
                                "ids": ids, "round_trip": same})
    return run


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK,
           group: int = GROUP) -> DataFrame:
    """One row per chunk of a document (most have one): doc_id, chunk, n_chunks, ids, and
    whether the ids decode to the text again."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    giant = F.coalesce(F.length("text"), F.lit(0)) >= 2 * chunk
    small = rows.where(~giant).mapInPandas(_small(model), IDS)
    chunks = rows.where(giant).withColumn("row", F.monotonically_increasing_id()).mapInPandas(
        _split(model, chunk), "row bigint, doc_id bigint, chunk int, n_chunks int, before string, text string, after string")
    # chunks of one document go to all executors
    chunks = pinned(chunks.repartition(F.col("row"), F.col("chunk")), "chunks")
    cells = pinned(chunks.mapInPandas(_matrices(model), f"row bigint, chunk int, cells {CELLS}"), "matrices")
    state = "row bigint, chunk int, a int, b int, c int, d int"
    grouped = cells.groupBy("row", F.floor(F.col("chunk") / group).cast("int")).applyInPandas(_combine, f"row bigint, chunk int, cells {CELLS}")
    top = grouped.groupBy("row").applyInPandas(_top, state).withColumnRenamed("chunk", "part")
    inner = cells.withColumn("part", F.floor(F.col("chunk") / group).cast("int")).join(top, ["row", "part"])
    states = inner.groupBy("row", "part").applyInPandas(_within, state)
    traced = chunks.withColumn("doc_id", F.col("doc_id").cast("string")).join(states, ["row", "chunk"]).mapInPandas(_trace(model), IDS)
    return small.unionByName(traced)


def _decode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for batch in batches:
            text = [model.surface(list(i)).replace(BLANK, " ") for i in batch["ids"]]
            text = [t[1:] if c == 0 else t for t, c in zip(text, batch["chunk"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "chunk": batch["chunk"], "text": text})
    return run


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, chunk, text) of encoded rows; the texts of a document's chunks, in order,
    are its text."""
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "chunk", "ids")
    return rows.mapInPandas(_decode(model), "doc_id bigint, chunk int, text string")
