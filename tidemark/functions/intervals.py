"""Column functions on intervals in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull of two intervals; 0 where they do not overlap."""
    inter, hull = F.least(e1, e2) - F.greatest(s1, s2), F.greatest(e1, e2) - F.least(s1, s2)
    return F.when((inter > 0) & (hull > 0), inter / hull).otherwise(F.lit(0.0))


def snap(value: Column, step: float, mode: str = "nearest") -> Column:
    """value on the grid of step (floor, ceil, or half-even nearest), six decimals; unchanged for step <= 0."""
    if step <= 0:
        return value
    ratio = value / F.lit(float(step))
    made = {"floor": F.floor, "ceil": F.ceil, "nearest": F.rint}.get(mode)
    if made is None:
        raise ValueError(f"mode is floor, ceil or nearest, not {mode}")
    return F.round(made(ratio) * F.lit(float(step)), 6)


def snap_interval(s: Column, e: Column, duration: Column, step: float, start_mode: str = "nearest", end_mode: str = "nearest") -> tuple[Column, Column]:
    """The interval clamped to [0, duration], put on the grid and clamped again; one step long where only the grid made it empty."""
    inside = lambda x: F.greatest(F.lit(0.0), F.least(x, duration))
    start, end = inside(snap(inside(s), step, start_mode)), inside(snap(inside(e), step, end_mode))
    lost = (inside(e) > inside(s)) & (end <= start)
    return start, F.when(lost, F.least(duration, F.round(start + F.lit(float(step)), 6))).otherwise(end)


def time_step(fps: Column) -> Column:
    """Seconds from frame to frame; raises for a rate of 0 or less."""
    return F.when(fps > 0, 1.0 / fps).otherwise(F.raise_error(F.concat(F.lit("fps must be positive: "), fps.cast("string"))).cast("double"))


def duration_for_frames(fps: Column, frames: Column) -> Column:
    """The longest duration that so many frames cover, six decimals."""
    return F.round(frames / fps, 6)


def frame_times(duration: Column) -> Column:
    """0.0, 1.0, ... below the duration; 0.0 alone for a duration of 0 or less."""
    last = F.greatest(F.ceil(duration).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda t: t.cast("double"))


def frame_index(t: Column, fps: Column, n_frames: Column) -> Column:
    """The frame nearest to time t (half-even), at most the last one."""
    return F.least(F.rint(t * fps).cast("long"), F.greatest(n_frames - 1, F.lit(0).cast("long")))


def even_dimension(x: Column, fallback: Column) -> Column:
    """The largest even integer up to x, or up to the fallback for x of 0 or less."""
    whole = F.when(x <= 0, fallback).otherwise(x).cast("int")
    return whole - F.pmod(whole, F.lit(2))


def output_fps(fps: Column) -> Column:
    """The nearest whole rate (half-even) from 1 to 60; 30 for 0 or less."""
    return F.when(fps <= 0, 30).otherwise(F.greatest(F.lit(1), F.least(F.lit(60), F.rint(fps).cast("int"))))


def grid_positions(duration: Column, count: Column, step: float, salt: Column) -> Column:
    """count different times on the grid of step up to the duration, in order: those with the smallest MD5 of ``salt:index``.

    Raises where the grid has fewer places.
    """
    last = F.floor(F.greatest(duration, F.lit(0.0)) / F.lit(float(step))).cast("int")
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.md5(F.concat_ws(":", salt, i.cast("string"))).alias("h"), i.alias("i"))))
    taken = F.array_sort(F.transform(F.slice(drawn, 1, count), lambda x: F.round(x["i"] * F.lit(float(step)), 6)))
    none = F.raise_error(F.lit("the time grid has too few places")).cast("array<double>")
    return F.when(count > last + 1, none).otherwise(taken)


def insertion_start(safe: Column, harmful: Column, limit: float, unit: Column) -> Column:
    """Where to insert: unit in [0, 1) scaled to the latest start that fits, three decimals."""
    latest = F.greatest(F.lit(0.0), F.least(safe, F.lit(float(limit)) - harmful))
    return F.when(latest <= 1e-6, F.lit(0.0)).otherwise(F.round(unit * latest, 3))


def inserted_intervals(start: Column, harmful: Column, total: Column, bits: Column) -> Column:
    """Up to three intervals: before, the inserted one (with bits), after; null if the inserted one is empty."""
    end = F.least(total, start + harmful)
    made = lambda s, e, b: F.struct(s.alias("s"), e.alias("e"), b.cast("int").alias("b"))
    parts = F.array(made(F.lit(0.0), start, F.lit(0)), made(start, end, bits), made(end, total, F.lit(0)))
    return F.when(end - start > 1e-6, F.filter(parts, lambda p: p["e"] - p["s"] > 1e-6))
