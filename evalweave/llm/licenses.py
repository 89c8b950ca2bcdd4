"""Licence scans: exact notices, and notices with a few edits.

A notice of length m may differ by m // 10 characters. Split into one more piece than
that, at least one piece must occur exactly (pigeonhole), so plain substring searches
locate candidates, and the regex library's bounded-error matching verifies each within
its window and yields its span.

Nulls: a null text has no words and no labels; null ids are carried. Very long texts take time
in proportion to their length. Notices that lie at the same place count each; the one with the
fewest edits makes the score. Repeated rows count each; an empty table gives an empty result.
Columns but id and text are not read, so that their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import small_batches

NOTICES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
CHARS_PER_EDIT = 10
#: A-Z become a-z; ASCII that is neither letter nor digit becomes a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RESULT = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<struct<label: string, first_word: bigint, n_words: bigint, edits: int>>")


class Notice:
    def __init__(self, phrase: str, label: str):
        self.text, self.label = phrase.encode(), label
        self.edits = len(self.text) // CHARS_PER_EDIT
        step = len(self.text) / (self.edits + 1)
        cuts = [round(k * step) for k in range(self.edits + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.exact = b" " + self.text + b" "
        # bytes keep the library from counting a multi-byte letter as several edits only
        # where a notice has such letters; notices are ASCII
        self.fuzzy = regex.compile(rb"(?b)(?<= )(?:" + regex.escape(phrase.encode()) + rb"){e<=%d}(?= )" % self.edits)


def places(text: bytes, needle: bytes) -> Iterator[int]:
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + 1)


def spans(padded: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the best approximate matches around each exact piece."""
    found = {}
    for offset, piece in notice.pieces:
        for at in places(padded, piece):
            lo = max(0, at - offset - notice.edits - 1)
            window = padded[lo:at - offset + len(notice.text) + notice.edits + 1]
            match = notice.fuzzy.search(window)
            if match:
                key = (lo + match.start(), lo + match.end())
                found[key] = sum(match.fuzzy_counts)
    return [(a, b, e) for (a, b), e in sorted(found.items())]


def scan_text(text: str | None, notices: list[Notice]) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    padded = b" " + b" ".join(words) + b" "
    found = []
    for notice in notices:
        exact = list(places(padded, notice.exact))
        near = spans(padded, notice) if notice.edits else [(x + 1, x + 1 + len(notice.text), 0) for x in exact]
        if exact or near:
            found.append((notice, exact, near))
    if not found:
        return len(words), 0, None, None, "", "", 0.0, []
    # the blank before each word, so that a place's word is a search and not a count
    blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
    word_at = lambda x: int(np.searchsorted(blanks, x))
    base, labels, out, best = [], set(), [], 0.0
    for notice, exact, near in found:
        base += exact
        if exact:
            labels.add(notice.label)
            best = 1.0
        for a, b, edits in near:
            first = word_at(a) - 1
            out.append((notice.label, first, word_at(b) - first, edits))
            best = max(best, 1 - edits / len(notice.text))
    starts = [word_at(x) for x in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {x[0] for x in out})), best, out)


def _scan(notices: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = [Notice(p, x) for p, x in notices.items()]
        for batch in batches:
            rows = [scan_text(t, wanted) for t in batch["text"]]
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_words": cols[0], "n_base": cols[1],
                "first_word": pd.array(cols[2], "Int64"), "last_word": pd.array(cols[3], "Int64"),
                "base_labels": cols[4], "labels": cols[5], "score": cols[6],
                "spans": [[dict(zip(("label", "first_word", "n_words", "edits"), s)) for s in x] for x in cols[7]]})
    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """Per row: word count, exact places and labels, all labels, score (1: an exact notice;
    0: none) and the spans of the approximate matches. One pass, no shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(_scan(notices or NOTICES), RESULT)
