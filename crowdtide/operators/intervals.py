"""Joins of time ranges: overlap, best overlap, nearest, containment, greedy one-to-one.

All of them ride on an equality key made of the stream key and a coarse time bin, so they run as hash joins, a long
session is cut along its time line, and no pair is produced twice: only the bin where both ranges have started counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.keys import overlap_micros
from crowdtide.sources.storage import settle

STREAM = ["session_id", "channel_id"]


def _bin(ts: Column, width: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(width * 1_000_000))


def overlap_pairs(
    left: DataFrame, right: DataFrame, on: Sequence[str], l: tuple[str, str], r: tuple[str, str], width: int
) -> DataFrame:
    """All pairs with the same key and a positive overlap, with ``overlap_us``. ``width``: bin width in seconds."""

    def binned(df: DataFrame, rng: tuple[str, str], mark: str) -> DataFrame:
        first = _bin(F.col(rng[0]), width)
        last = _bin(F.col(rng[1]) - F.expr("INTERVAL 1 MICROSECOND"), width)
        proper = df.where(F.col(rng[1]) > F.col(rng[0]))
        return proper.withColumn(mark, first).withColumn("_bin", F.explode(F.sequence(F.col(mark), last)))

    pairs = binned(left, l, "_lbin").join(binned(right, r, "_rbin"), [*on, "_bin"])
    return (
        pairs.where(F.col("_bin") == F.greatest("_lbin", "_rbin"))
        .withColumn("overlap_us", overlap_micros(F.col(l[0]), F.col(l[1]), F.col(r[0]), F.col(r[1])))
        .where(F.col("overlap_us") > 0)
        .drop("_bin", "_lbin", "_rbin")
    )


def best_overlap(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_id: Sequence[str],
    l: tuple[str, str],
    r: tuple[str, str],
    width: int,
    keep: Sequence[str],
    prefer: Column | None = None,
) -> DataFrame:
    """Every left row with the right row of largest overlap, earliest start on ties; NULLs without one.

    ``prefer`` is an optional boolean over the pair that beats any overlap (an exact match, for instance).
    """
    first = F.lit(True) if prefer is None else F.coalesce(prefer, F.lit(False))
    rank = F.struct(
        first.alias("p"), F.col("overlap_us").alias("o"), (-F.unix_micros(r[0])).alias("s"), (-F.unix_micros(r[1])).alias("e")
    )
    pairs = overlap_pairs(left.select(*dict.fromkeys([*on, *left_id, *l])), right, on, l, r, width)
    key = list(dict.fromkeys([*on, *left_id]))
    best = pairs.groupBy(*key).agg(F.max_by(F.struct(*keep, "overlap_us"), rank).alias("_best"))
    return left.join(best, key, "left").withColumns({c: F.col(f"_best.{c}") for c in [*keep, "overlap_us"]}).drop("_best")


def _nearest_points(lefts: DataFrame, points: DataFrame, on: Sequence[str], key: Sequence[str], width: int) -> DataFrame:
    """(key, _near): the row of ``points`` whose ``_m`` is closest to each left ``_m``, the earlier one on ties.

    Both sides are cut into slices of time. A slice is lent the last point before it and the first one after it, which
    come from one row per slice; then neighbours are found inside slices, so no task sorts a whole stream.
    """
    slice_ = F.floor(F.col("_m") / F.lit(width * 1_000_000)).alias("_slice")
    lefts, points = lefts.select(*key, "_m", slice_), points.select(*on, "_m", "_row", slice_)
    ends = points.groupBy(*on, "_slice").agg(F.min(F.struct("_m", "_row")).alias("_first"), F.min(F.struct((-F.col("_m")).alias("_n"), "_row")).alias("_last"))
    wanted = lefts.select(*on, "_slice", F.lit(True).alias("_wanted")).distinct()
    slices = ends.unionByName(wanted, allowMissingColumns=True).groupBy(*on, "_slice")
    slices = slices.agg(F.max("_wanted").alias("_wanted"), F.first("_first", ignorenulls=True).alias("_first"), F.first("_last", ignorenulls=True).alias("_last"))
    stream = Window.partitionBy(*on)
    before = F.last("_last._row", ignorenulls=True).over(stream.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first._row", ignorenulls=True).over(stream.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1))
    lent = slices.withColumns({"_before": before, "_after": after}).where("_wanted").withColumn("_row", F.explode(F.array("_before", "_after")))
    lent = lent.where("_row IS NOT NULL").select(*on, "_slice", F.col("_row.m").alias("_m"), "_row")
    right = points.unionByName(lent).withColumn("_is_right", F.lit(True))
    # both neighbours by growing frames: looking ahead is looking back in the reverse order; of equal points the least row is last
    first = [F.col("_is_right").desc_nulls_last(), F.desc("_row")]
    inside = Window.partitionBy(*on, "_slice")
    back = F.last("_row", ignorenulls=True).over(inside.orderBy("_m", *first).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_row", ignorenulls=True).over(inside.orderBy(F.desc("_m"), *first).rowsBetween(Window.unboundedPreceding, 0))
    both = right.unionByName(lefts, allowMissingColumns=True).withColumns({"_back": back, "_ahead": ahead}).where("_is_right IS NULL")
    closer = F.col("_ahead").isNull() | (F.col("_m") - F.col("_back.m") <= F.col("_ahead.m") - F.col("_m"))
    return both.select(*key, F.when(closer, F.col("_back")).otherwise(F.col("_ahead")).alias("_near"))


def nearest_window(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_id: Sequence[str],
    l: tuple[str, str],
    r: tuple[str, str],
    width: int,
    keep: Sequence[str],
    offset_seconds: float = 0.0,
    exact: tuple[str, str] | None = None,
) -> DataFrame:
    """Largest overlap, else the right row whose midpoint is closest (the earlier one on ties).

    The left range is shifted by ``offset_seconds``, at most two minutes either way. ``exact`` names a left and a right
    column; a right row of the same stream in which they are equal wins outright, the least one of several, unless there
    is a shift. ``width``: seconds in a slice of time.
    """
    shift = round(offset_seconds)
    if abs(shift) > 120:
        raise ValueError("offset_seconds lies within two minutes")
    move = F.expr(f"INTERVAL {shift} SECONDS")
    ls, le = "_ls", "_le"
    shifted = left.withColumns({ls: F.col(l[0]) + move, le: F.col(l[1]) + move})
    key = list(dict.fromkeys([*on, *left_id]))
    hit = best_overlap(shifted, right, on, left_id, (ls, le), r, width, keep)

    def mid(a: str, b: str) -> Column:
        return (F.unix_micros(a) + F.unix_micros(b)) / 2

    packed = F.struct(mid(*r).alias("m"), *[F.col(c) for c in keep])
    near = _nearest_points(shifted.select(*key, mid(ls, le).alias("_m")), right.select(*on, mid(*r).alias("_m"), packed.alias("_row")), on, key, width)
    out = hit.join(near, key, "left")
    for c in keep:
        out = out.withColumn(c, F.when(F.col("overlap_us").isNotNull(), F.col(c)).otherwise(F.col(f"_near.{c}")))
    out = out.withColumn("overlap_us", F.coalesce("overlap_us", F.lit(0))).drop("_near", ls, le)
    if exact is None or shift != 0:
        return out
    same = right.where(F.col(exact[1]).isNotNull()).groupBy(*on, F.col(exact[1]).alias("_same")).agg(F.min(F.struct(*keep)).alias("_exact"))
    out = out.withColumn("_same", F.col(exact[0])).join(same, [*on, "_same"], "left")
    return out.withColumns({c: F.when(F.col("_exact").isNotNull(), F.col(f"_exact.{c}")).otherwise(F.col(c)) for c in keep}).drop("_exact", "_same")


_ITEM, _PICKER = ["i0", "i1", "i2"], ["p0", "p1", "p2"]


def _greedy(pdf: pd.DataFrame, taken: set[tuple]) -> list[tuple]:
    """Pickers in time order take their best item that is still free; an unusable one ends the search without taking."""
    ordered = pdf.sort_values([*_PICKER, "overlap_us", *_ITEM], ascending=[True] * 3 + [False] + [True] * 3)
    done, picks = set(), []
    for *pair, usable in ordered[[*_PICKER, *_ITEM, "usable"]].itertuples(index=False, name=None):
        who, what = tuple(pair[:3]), tuple(pair[3:])
        if who in done or what in taken:
            continue
        done.add(who)
        if usable:
            taken.add(what)
            picks.append((*who, *what))
    return picks


def _match_stretch(keys: list[str]):
    """Match one stretch of time, given the items earlier stretches have taken."""

    def run(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        columns = [*_PICKER, *_ITEM]
        picks = pd.DataFrame(_greedy(pdf, set(entry[_ITEM].itertuples(index=False, name=None))) if len(pdf) else [], columns=columns)
        for k in (*keys, "chunk"):
            picks[k] = pdf[k].iloc[0] if len(pdf) else None
        return picks[[*keys, "chunk", *columns]]

    return run


def numbered(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Tell rows with the same keys apart by a number from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*df.columns))) - 1)


#: Rounds of dominant pairs before what is left is matched in stretches of time.
ROUNDS = 3


def _dominant(candidates: DataFrame, group: Sequence[str], picker: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Candidates with ``_final`` (the pair is decided) and ``_open`` (nothing about it is decided yet).

    A pair is decided if the item is the first choice of its picker and no earlier picker has the item among its
    candidates: nobody can take it away, whatever the others do. The picker's other candidates are void then, and so are
    the item's, unless the pick yields nothing.
    """
    by_picker, by_item = Window.partitionBy(*group, *picker), Window.partitionBy(*group, *item)
    choice = by_picker.orderBy(F.desc("overlap_us"), *item)
    flagged = candidates.withColumn("_first", F.row_number().over(by_item.orderBy(*picker)) == 1)
    flagged = flagged.withColumn("_final", (F.row_number().over(choice) == 1) & F.col("_first"))
    flagged = flagged.withColumn("_served", F.max("_final").over(by_picker))
    flagged = flagged.withColumn("_taken", F.max(F.col("_final") & F.col("usable")).over(by_item))
    return flagged.withColumn("_open", ~F.col("_served") & ~F.col("_taken")).drop("_first", "_served", "_taken")


def one_to_one(
    candidates: DataFrame, group: Sequence[str], picker: tuple[str, str, str], item: tuple[str, str, str], chunk_seconds: int = 30_720
) -> DataFrame:
    """Greedy matching of ranges: pickers by time, each taking the free item of largest overlap.

    ``picker`` and ``item``: start, end, and a number that tells equal ranges apart. ``usable`` false means that the
    pick yields nothing.

    Each round decides all dominant pairs at once, in SQL, on what earlier rounds left; a candidate without a rival is
    decided in the first one. Only a chain in which each pick waits for the one before it outlasts ``ROUNDS`` rounds. It
    is matched in stretches of time, see ``_match_in_stretches``. The rounds run while the result is built; each stores
    its candidates once, and there is one table where nothing is contested.
    """
    won, left = None, candidates
    for _ in range(ROUNDS):
        flagged = settle(_dominant(left, group, picker, item), "candidates")
        mine = flagged.where("_final AND usable").drop("_final", "_open")
        won = mine if won is None else won.unionByName(mine)
        left = flagged.where("_open").drop("_final", "_open")
        if left.isEmpty():
            return won
    return won.unionByName(_match_in_stretches(left, group, picker, item, chunk_seconds))


def _match_in_stretches(
    rest: DataFrame, group: Sequence[str], picker: tuple[str, str, str], item: tuple[str, str, str], chunk_seconds: int
) -> DataFrame:
    """Greedy matching of chains.

    The candidates are cut into stretches of time, all matched at once as if nothing had been taken before them. What
    earlier stretches really took is then compared with what each stretch assumed, and those that differ are matched
    again, until none does. A task never holds more than one stretch, and each round settles at least the next stretch
    of every stream; usually two rounds do.
    """
    g = list(group)
    ids = {**{k: F.unix_micros(c) for k, c in zip(("p0", "p1", "i0", "i1"), (*picker[:2], *item[:2]))}, "p2": F.col(picker[2]).cast("long"), "i2": F.col(item[2]).cast("long")}
    rest = rest.withColumns(ids)
    slim = settle(rest.select(*g, *ids, "overlap_us", "usable").withColumn("chunk", F.floor(F.col("p0") / F.lit(chunk_seconds * 1_000_000))), "contested")
    stretch = [*g, "chunk"]
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in stretch] + [f"{k} bigint" for k in (*_PICKER, *_ITEM)])

    def match(rows: DataFrame, entry: DataFrame) -> DataFrame:
        return rows.groupBy(*stretch).cogroup(entry.groupBy(*stretch)).applyInPandas(_match_stretch(g), schema)

    places = settle(slim.select(*g, *_ITEM, F.col("chunk").alias("_later")).distinct(), "places")
    assumed = slim.select(*stretch, *_ITEM).where(F.lit(False))
    picks = settle(match(slim, assumed), "picks")
    while True:
        taken = picks.select(*g, *_ITEM, "chunk").join(places, [*g, *_ITEM]).where(F.col("_later") > F.col("chunk"))
        entry = settle(taken.select(*g, F.col("_later").alias("chunk"), *_ITEM).distinct(), "entry")
        differing = entry.unionByName(assumed).groupBy(*stretch, *_ITEM).count().where("count = 1").select(*stretch).distinct()
        differing = settle(differing, "differing")
        if differing.isEmpty():
            break
        again = match(slim.join(differing, stretch, "left_semi"), entry.join(differing, stretch, "left_semi"))
        picks = settle(picks.join(differing, stretch, "left_anti").unionByName(again), "picks")
        assumed = entry
    return rest.join(picks.drop("chunk"), [*g, *_PICKER, *_ITEM]).drop(*ids)


def drop_superseded(provisional: DataFrame, committed: DataFrame, on: Sequence[str], child: tuple[str, str], parent: tuple[str, str], width: int) -> DataFrame:
    """Provisional ranges that no committed range contains."""
    p = committed.select(*on, F.col(parent[0]).alias("_ps"), F.col(parent[1]).alias("_pe"))
    p = p.withColumn("_bin", F.explode(F.sequence(_bin(F.col("_ps"), width), _bin(F.col("_pe"), width))))
    c = provisional.withColumn("_bin", _bin(F.col(child[0]), width))
    covered = (c["_bin"] == p["_bin"]) & (p["_ps"] <= c[child[0]]) & (c[child[1]] <= p["_pe"])
    same = covered
    for k in on:
        same = same & (c[k] == p[k])
    return c.join(p, same, "left_anti").drop("_bin")


def points_in_windows(windows: DataFrame, events: DataFrame, on: Sequence[str], rng: tuple[str, str], at: str, width: int) -> DataFrame:
    """Window/event pairs, both ends inclusive, for events that carry a time."""
    w = windows.withColumn("_bin", F.explode(F.sequence(_bin(F.col(rng[0]), width), _bin(F.col(rng[1]), width))))
    e = events.where(F.col(at).isNotNull()).withColumn("_bin", _bin(F.col(at), width))
    return w.join(e, [*on, "_bin"]).where(F.col(at).between(F.col(rng[0]), F.col(rng[1]))).drop("_bin")


def events_in_window(windows: DataFrame, events: DataFrame, on: Sequence[str], rng: tuple[str, str], at: str, width: int) -> DataFrame:
    """Events per window. Events without a time belong to every window of their session: they are counted once per
    session and added, instead of being paired with each window."""
    key = [*on, *rng]
    timed = points_in_windows(windows.select(*key), events, on, rng, at, width).groupBy(*key).agg(F.count("*").alias("_timed"))
    untimed = events.where(F.col(at).isNull()).groupBy(*on).agg(F.count("*").alias("_untimed"))
    total = F.coalesce("_timed", F.lit(0)) + F.coalesce("_untimed", F.lit(0))
    return windows.join(timed, key, "left").join(untimed, list(on), "left").withColumn("event_count", total).drop("_timed", "_untimed")
