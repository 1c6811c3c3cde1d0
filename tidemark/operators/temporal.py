"""Temporal primitives over half-open intervals [from, to) whose null end is open."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from heapq import heappop, heappush
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rel import first_per_group, semi

FOREVER = "9999-12-31"
FACT_KEY = ["cik", "tag", "value_date", "qtrs", "uom", "coreg", "segments"]


def asof_pred(start: Column, end: Column, at: Column) -> Column:
    """In force at ``at``."""
    return (start <= at) & (end.isNull() | (end > at))


def vintage_chain(facts: DataFrame, keys: Sequence[str] = FACT_KEY, order: Sequence[str] = ("known_at", "adsh"), known: str = "known_at", tradable: str = "tradable_from") -> DataFrame:
    """Number the versions of each key and close each version where the next begins; one sort of one window."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    seq, size = F.row_number().over(w).cast("long"), F.count("*").over(Window.partitionBy(*keys))
    return facts.select(
        "*",
        seq.alias("vintage_seq"),
        F.lead(known).over(w).alias("superseded_known_at"),
        F.lead(tradable).over(w).alias("superseded_tradable"),
        seq.alias("rank_pit"),
        (size - seq + 1).alias("rank_latest"),
    )


CHAIN_COLUMNS = ["vintage_seq", "superseded_known_at", "superseded_tradable", "rank_pit", "rank_latest"]


#: Sources of a batch that are sent to every task at most; beyond that the old rows are shuffled by source.
SOURCES = 500_000


def fold_chain(old: DataFrame, new: DataFrame, keys: Sequence[str] = FACT_KEY, source: str = "adsh", **chain) -> DataFrame:
    """Fold new facts into a built chain: only touched keys are rebuilt, from their old rows of other filings plus the new.

    ``old`` has the chain's columns, ``new`` has not; folding twice equals folding once.  Old and new rows meet in one window
    over the keys, which tells the touched ones, so rows move once; the sources of ``new`` are counted first.
    """
    keys = list(keys)
    facts = [c for c in old.columns if c not in CHAIN_COLUMNS]
    sources = new.select(F.col(source).alias("_source"), F.lit(True).alias("_again")).distinct()
    if sources.limit(SOURCES + 1).count() <= SOURCES:
        sources = F.broadcast(sources)
    marked = old.join(sources, F.col(source).eqNullSafe(F.col("_source")), "left")
    before = marked.select(*facts, F.struct(*CHAIN_COLUMNS).alias("_chain"), F.coalesce("_again", F.lit(False)).alias("_again"))
    # dealt by key, for an old chain that is dealt so stays where it is
    after = new.repartition(*keys).withColumns({"_chain": F.lit(None).cast(before.schema["_chain"].dataType), "_again": F.lit(False)})
    rows = before.unionByName(after)
    order = [F.col(c).asc_nulls_last() for c in chain.get("order", ("known_at", "adsh"))]
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.withColumn("_touched", F.max(F.col("_chain").isNull()).over(whole)).where(~(F.col("_touched") & F.col("_again")))
    rebuilt = vintage_chain(told, keys, **chain)
    kept = {c: F.when(F.col("_touched"), F.col(c)).otherwise(F.col(f"_chain.{c}")) for c in CHAIN_COLUMNS}
    return rebuilt.withColumns(kept).select(*old.columns)


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, take: Sequence[str], by: Sequence[str] = (), direction: str = "forward", strict: bool = True, tolerance_days: int | None = None) -> DataFrame:
    """Each left row with the nearest right row after (``forward``) or before it; at the same time too unless ``strict``.

    Keyed joins sort each key's rows once.  Without keys the rows are dealt by month, and a month's rows that find nothing
    inside take the nearest right row of the other months from a table with a row a month.  Left rows with a null time or a
    null key find nothing, and right rows with one are not found.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    names = left.columns
    lost = reduce(or_, [F.col(c).isNull() for c in (left_on, *by)])
    nothing = left.where(lost)  # they take no part in the windows, where nulls would meet in one
    left = left.where(~lost)
    for c in by:
        right = right.where(F.col(c).isNotNull())
    month = lambda c: F.date_trunc("MM", F.col(c).cast("timestamp"))
    keys = list(by) or ["_month"]
    if not by:
        left, right = left.withColumn("_month", month(left_on)), right.withColumn("_month", month(right_on))
    payload = F.struct(F.col(right_on).alias("_at"), *[F.col(c).alias(c) for c in take])
    row = F.struct(*[F.col(c) for c in names])
    a = left.select(*keys, F.col(left_on).alias("_t"), F.lit(0).alias("_side"), row.alias("_row"))
    b = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_t"), F.lit(1).alias("_side"), payload.alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    forward = direction == "forward"
    time = F.col("_t").desc() if forward else F.col("_t").asc()
    side = F.col("_side").asc() if strict else F.col("_side").desc()
    w = Window.partitionBy(*keys).orderBy(time, side, F.col("_hit").desc() if forward else F.col("_hit").asc())
    hit = F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_hit", hit).where("_side = 0")
    if not by:
        pick = F.min("_hit") if forward else F.max("_hit")
        months = b.groupBy("_month").agg(pick.alias("_edge")).unionByName(found.select("_month").distinct(), allowMissingColumns=True)
        edge = months.groupBy("_month").agg(F.max("_edge").alias("_edge"))
        order = F.col("_month").desc() if forward else F.col("_month").asc()
        beyond = F.last("_edge", ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        found = found.join(edge.select("_month", beyond.alias("_beyond")), found["_month"].eqNullSafe(edge["_month"]), "left").withColumn("_hit", F.coalesce("_hit", "_beyond"))
    if tolerance_days is not None:
        near = F.abs(F.datediff(F.col("_hit._at"), F.col("_t"))) <= tolerance_days
        found = found.withColumn("_hit", F.when(near, F.col("_hit")))
    out = found.select(*[F.col(f"_row.{c}").alias(c) for c in names], *[F.col(f"_hit.{c}").alias(c) for c in take])
    return out.unionByName(nothing.select(*names), allowMissingColumns=True)


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points with the intervals of their key that hold them: an equi-join with a residual, never a nested loop."""
    right = intervals.select(*[F.col(c).alias(f"_i_{c}") if c in keys else F.col(c) for c in intervals.columns])
    on = asof_pred(F.col(start), F.col(end), F.col(at))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_i_{k}"))
    return points.join(right, on, how).drop(*[f"_i_{k}" for k in keys])


def days_between(later: str | Column, earlier: str | Column, low: int, high: int) -> Column:
    return F.datediff(later, earlier).between(low, high)


def nearest_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, take: Sequence[str], ids: Sequence[str], within_days: int | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """Each left row (named by ``ids``) with the right row of its key nearest in time, by days; ``ties`` (over ``take``) rank
    equally near ones, then the earlier one.

    Two as-of passes over each key's rows, before and after, leave two candidates a row at most; nothing is paired beyond
    that.  Rows with a null key or time find nothing.
    """
    day = F.to_date(right_on)
    r = right.where(F.col(by).isNotNull() & F.col(right_on).isNotNull()).select(F.col(by).alias(by), day.alias("_day"), F.col(right_on).alias("_at"), *take)
    best = first_per_group(r, [by, "_day"], [*ties, F.col("_at").asc()])  # one row a key and day
    rows = left.withColumn("_on", F.to_date(left_on))
    hit = best.select(by, "_day", F.struct("_at", *take).alias("_c"))
    both = rows
    for direction in ("backward", "forward"):
        both = asof_join(both, hit.withColumnRenamed("_c", f"_{direction}"), "_on", "_day", [f"_{direction}"], [by], direction, strict=direction == "forward")
    near = both.withColumn("_c", F.explode_outer(F.array_compact(F.array("_backward", "_forward"))))
    away = F.abs(F.datediff("_c._at", "_on"))
    if within_days is not None:
        near = near.withColumn("_c", F.when(away <= within_days, F.col("_c")))
    found = near.select(*left.columns, away.alias("_away"), F.col("_c._at").alias("_at"), *[F.col(f"_c.{c}").alias(c) for c in take])
    return first_per_group(found, ids, [F.col("_away").asc_nulls_last(), *ties, F.col("_at").asc()]).drop("_away", "_at")


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive numbers per key: (keys, first, last, n)."""
    rows = df.select(*keys, number).distinct()
    w = Window.partitionBy(*keys).orderBy(number)
    runs = rows.withColumn("_run", F.col(number) - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_run")


def numbered_captures(captures: DataFrame, day: str = "observed_on", partial: str = "is_partial") -> DataFrame:
    """Captures with a dense number sn and np, how many captures up to and with this one are not partial.

    A row per capture day: small by nature (days of history), hence one window over all of it.
    """
    w = Window.orderBy(day)
    return captures.select(F.col(day), F.col(partial), F.row_number().over(w).cast("long").alias("sn"), F.sum(F.when(F.col(partial), 0).otherwise(1)).over(w).cast("long").alias("np"))


def bridge_islands(sightings: DataFrame, captures: DataFrame, keys: Sequence[str], day: str = "observed_on", max_gap_days: int = 200) -> DataFrame:
    """Runs of sightings that continue over silences of at most ``max_gap_days`` or in which every capture is partial.

    (keys, valid_from, last_seen, valid_to): valid_to is the first capture after the last sighting, null in the newest.
    """
    known = numbered_captures(captures, day)
    seen = sightings.select(*keys, day).distinct().join(known, day)
    w = Window.partitionBy(*keys).orderBy("sn")
    gap = F.datediff(day, F.lag(day).over(w)) > max_gap_days
    # np before this capture minus np at the previous sighting: whole captures strictly between
    between = F.col("np") - F.when(F.col("is_partial"), 0).otherwise(1) - F.lag("np").over(w)
    broken = F.lag("sn").over(w).isNull() | ((F.col("sn") - F.lag("sn").over(w) > 1) & gap & (between > 0))
    runs = seen.withColumn("_run", F.sum(broken.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*keys, "_run").agg(F.min(day).alias("valid_from"), F.max(day).alias("last_seen"), (F.max("sn") + 1).alias("_next")).drop("_run")
    after = known.select(F.col("sn").alias("_next"), F.col(day).alias("valid_to"))
    return spans.join(after, "_next", "left").drop("_next")


def merge_intervals(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Unions of overlapping or touching intervals: (keys, lo, hi)."""
    end = F.coalesce(F.col(hi), F.lit(FOREVER).cast(df.schema[hi].dataType))
    rows = df.select(*keys, lo, end.alias("_hi"))
    w = Window.partitionBy(*keys).orderBy(lo, "_hi")
    before = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("_new", (before.isNull() | (F.col(lo) > before)).cast("int"))
    runs = new.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(F.min(lo).alias(lo), F.max("_hi").alias("_hi")).drop("_run")
    return out.select(*keys, lo, F.when(F.col("_hi") != F.lit(FOREVER).cast(df.schema[hi].dataType), F.col("_hi")).alias(hi))


def clip_intervals(df: DataFrame, lo: str, hi: str, not_before: Column, not_after: Column) -> DataFrame:
    """Intervals cut to [not_before, not_after); null bounds do not cut, inverted and empty leftovers go."""
    cut = df.withColumns({lo: F.greatest(F.col(lo), not_before), hi: F.least(F.col(hi), not_after)})
    return cut.where(F.col(hi).isNull() | (F.col(lo) < F.col(hi)))


def _swept(rows):
    """Disjoint segments (key, from, to, payload) of rows (key, lo, hi, rank, payload) that come by key and lo.

    At any moment the least rank among the intervals in force holds; only those are kept.  A null end is open.
    """
    key, at, active, last = None, None, [], None  # active: a heap of (rank, end, payload); last: the segment not yet told

    def until(moment):
        """Tell what holds from ``at`` to ``moment`` (None: for good); intervals that end on the way go."""
        nonlocal at
        while active:
            rank, end, payload = active[0]
            if end is not None and at is not None and end <= at:
                heappop(active)
                continue
            stop = moment if end is None or (moment is not None and moment < end) else end
            if stop is None or at < stop:
                yield at, stop, payload
            at = stop
            if stop is None or stop == moment:
                return

    def joined(segments):
        nonlocal last
        for start, stop, payload in segments:
            if last and last[2] == start and last[3] == payload:
                last = (key, last[1], stop, payload)
            else:
                if last:
                    yield last
                last = (key, start, stop, payload)

    for k, lo, hi, rank, payload in rows:
        if k != key:
            yield from joined(until(None))
            if last:
                yield last
            key, at, last = k, lo, None
            active.clear()
        yield from joined(until(lo))
        at = lo
        heappush(active, (rank, hi, payload))
    yield from joined(until(None))
    if last:
        yield last


def flatten_intervals(df: DataFrame, keys: Sequence[str], lo: str, hi: str, payload: Sequence[str], precedence: Sequence[Column]) -> DataFrame:
    """Disjoint timeline: at every moment the covering interval that is first in ``precedence`` (made total by the payload);
    neighbours that abut and have the same payload become one.

    A sweep over each key's intervals in the order of their starts, which holds only those in force; the rows of a task go
    through it in batches.  Intervals without a start, without a key or without length cover nothing.
    """
    from pyspark.sql import types as T

    keys, payload = list(keys), list(payload)
    held = F.col(lo).isNotNull() & (F.col(hi).isNull() | (F.col(lo) < F.col(hi)))
    for k in keys:
        held = held & F.col(k).isNotNull()
    order = [*precedence, F.col(lo).desc(), F.struct(*payload).asc(), F.col(hi).desc_nulls_first()]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.where(held).withColumn("_rank", rank).select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), "_rank", *payload)
    fields = {f.name: f for f in df.schema.fields}
    out = T.StructType([*[fields[c] for c in keys], T.StructField(lo, fields[lo].dataType), T.StructField(hi, fields[hi].dataType), *[T.StructField(c, fields[c].dataType) for c in payload]])
    n, size = len(keys), 50_000

    def sweep(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)

        def rows():
            for b in batches:
                for r in zip(*[c.to_pylist() for c in b.columns]):
                    yield r[:n], r[n], r[n + 1], r[n + 2], r[n + 3 :]

        def batch(told):
            columns = zip(*[(*k, start, stop, *what) for k, start, stop, what in told])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        told = []
        for segment in _swept(rows()):
            told.append(segment)
            if len(told) == size:
                yield batch(told)
                told = []
        if told:
            yield batch(told)

    # the window has brought each key's rows together; they stay where they are
    return rows.sortWithinPartitions(*keys, "_lo", "_rank").mapInArrow(sweep, out)


def label_segments(df: DataFrame, keys: Sequence[str], day: str, label: str) -> DataFrame:
    """Contiguous stretches of one label (nulls equal) inside a key: (keys, label, from, to), each ending where the next begins."""
    w = Window.partitionBy(*keys).orderBy(day)
    change = (F.row_number().over(w) == 1) | ~F.col(label).eqNullSafe(F.lag(label).over(w))
    runs = df.withColumn("_run", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*keys, "_run").agg(F.first(label).alias(label), F.min(day).alias("valid_from"))
    return out.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("_run"))).drop("_run")


# --- trading calendar -----------------------------------------------------------------------------------------------


def session_days(calendar: DataFrame, lead_days: int = 31) -> DataFrame:
    """A row per calendar day with the first session on or after it and the one after that; small by nature."""
    w = Window.orderBy("session_date")
    rows = calendar.select(
        F.coalesce(F.date_add(F.lag("session_date").over(w), 1), F.date_sub("session_date", lead_days)).alias("lo"),
        "session_date", "close_at", F.lead("session_date").over(w).alias("next_session"),
    )
    return rows.select(F.explode(F.sequence("lo", "session_date")).alias("day"), "session_date", "close_at", "next_session")


def availability(filings: DataFrame, calendar: DataFrame, known: str = "known_at", out: str = "tradable_from", zone: str = "America/New_York") -> DataFrame:
    """The first session whose bell rings strictly after the filing became known: an equi-join by day."""
    days = session_days(calendar)
    day = F.to_date(F.from_utc_timestamp(F.col(known), zone))
    joined = filings.withColumn("_day", day).join(days.withColumnRenamed("day", "_day"), "_day", "left")
    session = F.when(F.col("close_at") > F.col(known), F.col("session_date")).otherwise(F.col("next_session"))
    return joined.withColumn(out, session).select(*filings.columns, out)


def shift_sessions(calendar: DataFrame, day, n: int):
    """The session n sessions before the last one on or before ``day`` (a date); n <= 0 is ``day`` itself.

    Raises ValueError for None and for days that fall off the calendar.
    """
    if day is None:
        raise ValueError("no knowledge date given")
    if n <= 0:
        return day
    back = calendar.where(F.col("session_date") <= F.lit(day)).orderBy(F.col("session_date").desc()).limit(n + 1)
    rows = back.agg(F.min("session_date").alias("d"), F.count("*").alias("k")).first()
    if rows["k"] < n + 1:
        raise ValueError(f"{day} less {n} sessions is before the calendar")
    return rows["d"]


def shift_sessions_column(df: DataFrame, calendar: DataFrame, day: str, n: int, out: str) -> DataFrame:
    """Set form of ``shift_sessions``: null where the session is off the calendar; two joins on small tables."""
    seq = calendar.select("session_date", F.row_number().over(Window.orderBy("session_date")).alias("_seq"))
    on_or_before = asof_join(df, seq, day, "session_date", ["_seq"], direction="backward", strict=False)
    target = seq.select((F.col("_seq") + n).alias("_seq"), F.col("session_date").alias(out))
    return on_or_before.join(target, "_seq", "left").drop("_seq")
