"""Small tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns named like those that operators use inside.
CLASHING = ["d", "sig", "token", "tokens", "host", "body", "kept", "n_words", "root", "node", "shard", "text_hash", "x0", "h", "chunk", "row"]


def awkward_rows():
    words = [f"w{k}" for k in range(400)]
    base = " ".join(words[:120])
    near = " ".join([*words[:60], "changed", *words[61:120]])
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", None, 1), (4, None, None, None, None),
        (5, "", "en", "b", 0), (6, " \t\n ", "en", "b", 4), (7, "one two", "en", "b", 7), (8, "ONE\ttwo", "en", "b", 7),
        (None, base, "en", "b", 1), (9, " ".join(words * 60), "de", "c", 1), (9, " ".join(words * 60), "de", "c", 1),
        (10, "same line here\nother text 1\nsame line here", "fr", "c", 3), (11, "Same Line Here \nother text 2", "fr", "c", 2),
        (2**53 + 1, "Éa É " + " ".join(words[200:280]), "fr", "c", 2), (12, "x", "fr", "c", 1),
    ]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def clashing(spark):
    from pyspark.sql import functions as F
    return awkward(spark).withColumns({c: F.lit(c) for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text, k):
    w = blank_words(ascii_low(text))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, k, percent):
    """[(doc_id, set size, component id)] of (doc_id, text) rows."""
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for (d, _), s, g in zip(rows, sets, group):
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None]
        out.append((d, len(s), min(ids, default=None)))
    return out


def folder_of(tmp_path, **tables):
    """A folder of Parquet tables, as the registered queries read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
