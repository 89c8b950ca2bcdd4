"""Order-dependent operators that never put a whole table or group in one task.

A window over a group is one task per group, so a group that holds a third of
the rows would be one huge task. Running totals here split every group by the
leading bits of its integer order key: 2**21 keys to a bucket, 2**21 buckets to
a super-bucket. Each window partition is therefore bounded for any 64-bit key,
hot groups included, and only bucket sums travel between the levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalweave.operators.sizes import measured
from evalweave.session import materialize

BUCKET_BITS = 21
INTEGERS = ("bigint", "int", "smallint", "tinyint")


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in on],
        *[F.col(c) for c in right.columns if c not in on],
    )
    match = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on]
    joined = left.join(renamed, match, how)
    return joined if how == "left_semi" else joined.drop(*[f"__r_{k}" for k in on])


def sum_before(weight: str, by: Sequence[str], order: str) -> Column:
    """Sum over the rows before this one in its window partition."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(w), F.lit(0)).cast("bigint")


def running_totals(
    df: DataFrame, order: str, weights: dict[str, Column], group: str | Sequence[str] = (),
) -> DataFrame:
    """Add, for each named weight, ``name`` (the sum before the row, in its group)
    and ``name_total`` (the sum over the group).

    ``order`` is a non-null bigint, unique within its group.
    """
    group = as_list(group)
    names = list(weights)
    base = df.withColumns({f"__w_{n}": w.cast("bigint") for n, w in weights.items()})
    base = base.withColumn("__mid", F.shiftright(order, BUCKET_BITS))

    def sums(source: str, target: str) -> list[Column]:
        return [F.sum(f"{source}_{n}").alias(f"{target}_{n}") for n in names]

    mid = base.groupBy(*group, "__mid").agg(*sums("__w", "__s"))
    mid = mid.withColumn("__hi", F.shiftright("__mid", BUCKET_BITS))
    hi = mid.groupBy(*group, "__hi").agg(*sums("__s", "__h"))
    hi = hi.select(
        *group, "__hi",
        *[sum_before(f"__h_{n}", group, "__hi").alias(f"__before_{n}") for n in names],
        *[F.sum(f"__h_{n}").over(W.partitionBy(*group)).alias(f"{n}_total") for n in names],
    )
    offsets = null_safe_join(mid, hi, [*group, "__hi"]).select(
        *group, "__mid", *[f"{n}_total" for n in names],
        *[(F.col(f"__before_{n}") + sum_before(f"__s_{n}", [*group, "__hi"], "__mid")).alias(f"__from_{n}")
          for n in names],
    )
    placed = null_safe_join(base, offsets, [*group, "__mid"])
    return placed.select(*df.columns, *[
        c for n in names for c in (
            (F.col(f"__from_{n}") + sum_before(f"__w_{n}", [*group, "__mid"], order)).alias(n),
            F.col(f"{n}_total"))])


def running_total(
    df: DataFrame,
    order: str,
    group: str | Sequence[str] = (),
    weight: Column | None = None,
    start: str = "start",
    total: str = "total",
) -> DataFrame:
    """``running_totals`` for one weight; with the default weight of 1, ``start`` is
    the 0-based position and ``total`` the group size."""
    weight = F.lit(1) if weight is None else weight
    placed = running_totals(df, order, {"__t": weight}, group)
    return placed.withColumnsRenamed({"__t": start, "__t_total": total})


def number_sorted(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1-based rank in any total order, of any column types.

    One range shuffle sorts the rows; positions inside each sorted partition are
    pinned by materialising them, and one small row per partition carries the
    offsets. Pass narrow rows.
    """
    pinned = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__pos", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__pos", 33))
    in_part = F.col("__pos") - F.shiftleft(F.col("__part"), 33)
    sizes = pinned.groupBy("__part").agg((F.max(in_part) + 1).alias("__n"))
    offsets = sizes.select("__part", sum_before("__n", [], "__part").alias("__offset"))
    # one row per shuffle partition, so the broadcast is bounded
    return pinned.join(F.broadcast(offsets), "__part").withColumn(
        name, (F.col("__offset") + in_part + 1).cast("bigint")
    ).select(*df.columns, name)


def integer_ordered(df: DataFrame, key: str, name: str = "__ord") -> tuple[DataFrame, str]:
    """``df`` and a bigint column that sorts as ``key``, of whatever type: the key itself if
    it is an integer, else its rank. Pass narrow rows."""
    if dict(df.dtypes)[key] in INTEGERS:
        return df.withColumn(name, F.col(key).cast("bigint")), name
    return number_sorted(df, [key], name), name


def dedup_first(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """First record per key; of several with that ``order`` the one with the smallest hash."""
    return _pick(df, as_list(key), order, F.min)


def dedup_last(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """Last record per key; of several with that ``order`` the one with the smallest hash."""
    return _pick(df, as_list(key), order, F.max)


def _pick(df: DataFrame, key: list[str], order: str, end) -> DataFrame:
    """The records come last: keys are two hashes until it is known which records stay, so
    that neither keys nor records are sorted, and only those that stay are joined.
    """
    nulls = [F.col(k).isNull() for k in key]  # hashes skip nulls
    names = {"__k1": F.xxhash64(*key, *nulls), "__k2": F.xxhash64(F.lit(1), *key, *nulls)}
    by = list(names)
    narrow = materialize(df.select(*[c.alias(n) for n, c in names.items()], F.col(order).alias("__o")))
    ends = measured(narrow.groupBy(*by).agg(end("__o").alias("__o"), F.count("*").alias("__n")))
    here = df.withColumns(names)
    first = ends.select(*[F.col(k).alias(f"{k}e") for k in by], F.col("__o").alias("__e"))
    match = [F.col(k) == F.col(f"{k}e") for k in by] + [F.col(order).eqNullSafe(F.col("__e"))]
    ties = narrow.join(ends.where("__n > 1").withColumnRenamed("__o", "__e"), by).where(F.col("__o").eqNullSafe(F.col("__e")))
    ties = measured(ties.groupBy(*by).count().where("count > 1").select(*by))  # only keys that occur twice can tie
    kept = here.join(first, match, "left_semi")
    if ties.isEmpty():
        return kept.select(*df.columns)
    rest = [c for c in df.columns if c not in key]
    tied = kept.join(ties, by, "left_semi").groupBy(*by, *key).agg(
        F.min_by(F.struct(*rest), F.xxhash64(F.to_json(F.struct(*rest)))).alias("__row"))
    return kept.join(ties, by, "left_anti").select(*df.columns).unionByName(tied.select(*key, "__row.*").select(*df.columns))


#: A step narrows the cut of a group to one of so many buckets.
CUT_BITS = 12


def cuts(keys: DataFrame, group: str, order: str, limit: int | float) -> DataFrame:
    """(group, upto): the key of the last row each group keeps.

    Per group a histogram of the leading bits tells which bucket holds that row; the next
    one covers that bucket only. No row is numbered, and a window holds 4,096 buckets.
    """
    keys = materialize(keys.select(F.col(group).alias("__g"), F.col(order).cast("bigint").alias("__o")))
    low, high = keys.agg(F.min("__o"), F.max("__o")).first()
    if low is None:
        return keys.select(F.col("__g"), F.col("__o").alias("__upto")).limit(0)
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << CUT_BITS:
        shift += 1
    counts = keys.groupBy("__g").agg(F.count("*").alias("n"))
    share = F.ceil(F.col("n") * F.lit(limit)) if isinstance(limit, float) else F.least(F.lit(limit), F.col("n"))
    state = counts.select("__g", share.cast("bigint").alias("need")).where("need > 0")
    left = keys
    while True:
        bucket = F.shiftright("__o", shift)
        hist = left.groupBy("__g", bucket.alias("b")).agg(F.count("*").alias("n"))
        upto = W.partitionBy("__g").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        placed = null_safe_join(hist.withColumn("through", F.sum("n").over(upto)), state, ["__g"])
        placed = placed.withColumn("need", F.col("need") - F.col("through") + F.col("n")).where("need between 1 and n")
        state = measured(placed.select("__g", "need", F.col("b").alias("cut")))
        if shift == 0:
            return state.select("__g", F.col("cut").alias("__upto"))
        left = null_safe_join(keys, state.select("__g", "cut"), ["__g"]).where(F.shiftright("__o", shift) == F.col("cut")).drop("cut")
        state = state.drop("cut")
        shift = max(0, shift - CUT_BITS)


def limit_per_group(df: DataFrame, group: str, order: str, limit: int | float) -> DataFrame:
    """0 keeps all, a whole number the first N, a fraction that share (rounded up)."""
    if isinstance(limit, bool) or limit < 0 or (isinstance(limit, float) and limit > 1):
        raise ValueError(f"limit must be 0, a whole number or a share in (0, 1]: {limit!r}")
    if limit == 0:
        return df
    keys, by = integer_ordered(df.select(group, order), order)
    last = cuts(keys, group, by, limit)
    if dict(df.dtypes)[order] in INTEGERS:
        return df.join(last, F.col(group).eqNullSafe(F.col("__g")) & (F.col(order) <= F.col("__upto")), "left_semi")
    kept = measured(null_safe_join(keys.withColumnRenamed(group, "__g"), last, ["__g"]).where(F.col(by) <= F.col("__upto")).select(
        "__g", F.col(order).alias("__o")))
    return df.join(kept, F.col(group).eqNullSafe(F.col("__g")) & (F.col(order) == F.col("__o")), "left_semi")


def first_user_turn(turns: DataFrame, human: str) -> DataFrame:
    """First human turn per chat; a chat whose first human turn is empty drops out."""
    first = dedup_first(turns.where(F.col("role") == human).select("conv_id", "turn", "text"), "conv_id", "turn")
    return first.where(F.coalesce(F.col("text"), F.lit("")) != "")


def latest_artifact(files: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Newest file per key, ties to the greatest path. ``files`` has path, mtime."""
    return files.groupBy(*as_list(key)).agg(
        F.max(F.struct("mtime", "path")).alias("__f")
    ).select(*as_list(key), "__f.path", "__f.mtime")


def _carried_turns(turns: DataFrame, human: str, mode: str) -> DataFrame:
    """(conv_id, turn, human, carried, chars, seq, history_chars): where each turn lies in what its
    chat carries. The one pass that measures texts leaves narrow rows, and so do the positions."""
    if mode not in ("every", "last", "every_with_gt"):
        raise ValueError(f"unknown mode {mode!r}")
    is_human = F.coalesce(F.col("role") == human, F.lit(False))
    carried = F.lit(True) if mode == "every_with_gt" else is_human
    narrow = materialize(turns.select(
        "conv_id", "turn", is_human.alias("human"), carried.alias("carried"),
        F.when(carried, F.coalesce(F.length("text"), F.lit(0))).otherwise(0).alias("chars")))
    return materialize(running_totals(
        narrow, "turn", {"seq": F.col("carried").cast("int"), "history_chars": F.col("chars")}, "conv_id"))


def turn_requests(turns: DataFrame, human: str, mode: str) -> DataFrame:
    """Inference requests of each chat.

    ``every``: one per human turn; ``last``: only the last one; ``every_with_gt``:
    one per human turn whose history carries the corpus replies, with the next
    turn as gold. The history is given by reference - the number of turns and
    characters before the request - so that a long chat is not copied once per
    turn. In the first two modes it holds the human turns only, for the model's own
    replies come between them. ``history_segments`` has its text.
    """
    placed = _carried_turns(turns, human, mode)
    wanted = placed.where("human")
    if mode == "last":
        last = wanted.groupBy("conv_id").agg(F.max("turn").alias("turn"))
        wanted = wanted.join(last, ["conv_id", "turn"], "left_semi")
    texts = turns.select("conv_id", "turn", "text")
    requests = texts.join(wanted.select("conv_id", "turn", "seq", "history_chars"), ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.col("seq").alias("history_turns"), "history_chars")
    if mode != "every_with_gt":
        return requests
    # the reply is the turn after the request, whoever speaks; no other text moves again
    asked = wanted.select("conv_id", F.col("seq").alias("history_turns"), (F.col("seq") + 1).alias("seq"))
    after = placed.select("conv_id", "turn", "seq").join(asked, ["conv_id", "seq"]).drop("seq")
    gold = texts.join(after, ["conv_id", "turn"]).select("conv_id", "history_turns", F.col("text").alias("gold"))
    return requests.join(gold, ["conv_id", "history_turns"], "left")


#: Characters of a segment of history.
SEGMENT = 1 << 16


def history_segments(turns: DataFrame, human: str, mode: str, size: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, text): what the requests of a chat carry, once.

    The carried turns of a chat, each with a line feed behind it, are one text, cut into
    segments of ``size`` characters, so that a chat of any length is shared by tasks and
    stored once. A request's history is the first ``history_chars + history_turns``
    characters of it: ``history_text`` reads that. A null text counts as empty.
    """
    placed = _carried_turns(turns, human, mode).where("carried")
    begin = F.col("history_chars") + F.col("seq")
    places = placed.select("conv_id", "turn", begin.alias("begin"), (begin + F.col("chars") + 1).alias("end"))
    lines = turns.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("line"))
    lines = lines.join(places, ["conv_id", "turn"]).withColumn("segment", F.explode(F.sequence(
        F.floor(F.col("begin") / size), F.floor((F.col("end") - 1) / size))))
    skip = F.greatest(F.col("segment") * size - F.col("begin"), F.lit(0))
    take = F.least(F.col("end"), (F.col("segment") + 1) * size) - F.col("begin") - skip
    parts = lines.select("conv_id", "segment", "begin", F.substring("line", (skip + 1).cast("int"), take.cast("int")).alias("part"))
    return parts.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("__p")).select(
        "conv_id", "segment", F.array_join(F.transform("__p", lambda p: p["part"]), "").alias("text"))


def history_text(requests: DataFrame, segments: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``requests`` with ``history``, their whole history text, from segments of ``size``: for
    requests about to be sent, as this copies what they share. Empty where nothing came before."""
    until = F.col("history_chars") + F.col("history_turns")
    wanted = requests.select("conv_id", "turn", until.alias("until"), F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((until - 1) / size))).alias("segment")).where("until > 0")
    parts = wanted.join(segments, ["conv_id", "segment"]).select("conv_id", "turn", "segment", F.substring(
        "text", F.lit(1), F.least(F.col("until") - F.col("segment") * size, F.lit(size)).cast("int")).alias("part"))
    whole = parts.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("segment", "part"))).alias("__p")).select(
        "conv_id", "turn", F.array_join(F.transform("__p", lambda p: p["part"]), "").alias("history"))
    return requests.join(whole, ["conv_id", "turn"], "left").withColumn("history", F.coalesce("history", F.lit("")))


def expand_requests(chats: DataFrame, human: str, mode: str) -> DataFrame:
    """``turn_requests`` for nested chats (one bounded array per row): the history
    is sliced out of the row itself, without a shuffle."""
    c = F.col("conversations")
    at = F.posexplode(c).alias("pos", "turn")
    rows = chats.select("id", "conversations", at).where(F.col("turn.from") == human)
    before = F.slice(c, F.lit(1), F.col("pos"))
    if mode != "every_with_gt":
        before = F.filter(before, lambda t: t["from"] == human)
    rows = rows.select(
        "id", "pos", F.col("turn.value").alias("prompt"), before.alias("history"),
        F.get(c, F.col("pos") + 1)["value"].alias("gold"),
        F.size(F.filter(F.slice(c, F.col("pos") + 2, F.size(c)), lambda t: t["from"] == human)).alias("later"),
    )
    if mode == "last":
        rows = rows.where(F.col("later") == 0)
    rows = rows.drop("later")
    return rows if mode == "every_with_gt" else rows.drop("gold")
