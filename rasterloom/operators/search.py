"""The search of an encoder setting for a score, within a fixed number of trials.

As a column expression, the whole search of a row is one fold over trial numbers, for scores that
are expressions themselves; nothing leaves the JVM. `search()` is the same state machine for Python
encoders, one row at a time inside an Arrow batch. Both follow proposed() and judged(), written once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual settings, and the range of each axis.
TOLERANCE, TRIALS = 1.0, 6
QUALITY, PALETTE = (1.0, 100.0), (2.0, 256.0)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def problem(target: Column, tolerance: Column, trials: Column, floor: Column, ceiling: Column, seed: Column, step: Column, axis: tuple[float, float] = QUALITY) -> Column:
    """Why settings are refused, or null."""
    low, high = axis
    inside = _finite(floor) & _finite(ceiling) & floor.between(low, high) & ceiling.between(low, high) & (floor <= ceiling)
    return (
        F.when(~_finite(target), "target must be finite")
        .when(~_finite(tolerance) | (tolerance < 0), "tolerance must be finite and not negative")
        .when(trials < 1, "at least one trial is needed")
        .when(~inside, "range must lie in the axis, floor first")
        .when(seed.isNotNull() & ~_finite(seed), "seed must be finite")
        .when(step.isNotNull() & (~_finite(step) | (step <= 0)), "step must be finite and positive")
    )


class _Columns:
    """What the rules of the search need, on columns."""

    def pick(self, *cases):
        """The value beside the first condition that holds; the last has none."""
        out = None
        for when, value in cases[:-1]:
            out = F.when(when, value) if out is None else out.when(when, value)
        return out.otherwise(cases[-1])

    no, given = staticmethod(lambda c: ~c), staticmethod(lambda c: c.isNotNull())
    number = staticmethod(lambda c: c.isNotNull() & ~F.isnan(c))
    size, root, rounded = staticmethod(F.abs), staticmethod(F.sqrt), staticmethod(F.round)
    less, more = staticmethod(F.least), staticmethod(F.greatest)


class _Numbers:
    """The same on plain numbers, where None is null."""

    def pick(self, *cases):
        return next((value for when, value in cases[:-1] if when), cases[-1])

    no, given = staticmethod(lambda x: not x), staticmethod(lambda x: x is not None)
    number = staticmethod(lambda x: x is not None and not math.isnan(x))
    size, less, more = staticmethod(abs), staticmethod(min), staticmethod(max)
    root = staticmethod(lambda x: math.sqrt(x))
    rounded = staticmethod(lambda x: half_up(x))


COLUMNS, NUMBERS = _Columns(), _Numbers()
#: What a search knows between trials. Missing values are null.
STATE = ("lo", "hi", "short", "reach", "step", "value", "best", "best_score", "best_reaches", "done")


def midpoint(low, high, geometric: bool, on=COLUMNS):
    return on.rounded(on.root(low * high) if geometric else (low + high) / 2)


def proposed(on, s, first_trial, last_trial, start, ceiling, geometric: bool):
    """(setting, step) of the next trial. start: the first setting, or null for the middle; step: null without a stride."""
    stepping = on.given(s["step"])
    # a null value or step can't be reckoned with, and isn't where the rules ask for it
    value, step = on.pick((on.given(s["value"]), s["value"]), s["lo"]), on.pick((stepping, s["step"]), 0.0)
    along = on.pick((s["reach"], on.more(on.rounded(value - step), s["lo"])), on.less(on.rounded(value + step), s["hi"]))
    middle = midpoint(s["lo"], s["hi"], geometric, on)
    desperate = last_trial & on.no(s["reach"])
    setting = on.pick((first_trial, on.pick((on.given(start), start), middle)), (desperate, ceiling), (stepping, along), middle)
    return setting, on.pick((stepping & on.no(first_trial) & on.no(desperate), step * 2), s["step"])


def judged(on, s, setting, step, score, target, tolerance: float) -> dict:
    """The state after a trial. A score that is no number reaches nothing and beats nothing, but the first setting is kept."""
    known = on.number(score)
    got, held = on.pick((known, score), 0.0), on.pick((on.number(s["best_score"]), s["best_score"]), 0.0)
    reaches = known & (got >= target - tolerance)
    first = on.no(on.given(s["best"]))
    smaller = on.no(s["best_reaches"]) | (setting < on.pick((first, setting), s["best"]))
    higher = on.no(s["best_reaches"]) & known & on.number(s["best_score"]) & (got >= held)
    better = first | on.pick((reaches, smaller), higher)
    lo, hi = on.pick((reaches, s["lo"]), setting), on.pick((reaches, setting), s["hi"])
    short, reach = s["short"] | on.no(reaches), s["reach"] | reaches
    nothing = F.lit(None).cast("double") if on is COLUMNS else None
    return {
        "lo": lo, "hi": hi, "short": short, "reach": reach, "step": on.pick((short & reach, nothing), step), "value": setting,
        "best": on.pick((better, setting), s["best"]), "best_score": on.pick((better, score), s["best_score"]), "best_reaches": on.pick((better, reaches), s["best_reaches"]),
        "done": (known & (on.size(got - target) <= tolerance)) | (hi - lo <= 1),
    }


def search_column(score: Callable[[Column], Column], target: Column, *, tolerance: float = TOLERANCE, trials: int = TRIALS, floor: Column | None = None, ceiling: Column | None = None, seed: Column | None = None, step: Column | None = None, geometric: bool = False, axis: tuple[float, float] = QUALITY) -> Column:
    """struct<value, score: double, iterations: int, reached, capped: boolean, trials: array<struct<value, score>>>."""
    d = lambda c: c.cast("double")
    lo0, hi0 = F.round(d(F.lit(axis[0]) if floor is None else floor)), F.round(d(F.lit(axis[1]) if ceiling is None else ceiling))
    null, no = F.lit(None).cast("double"), F.lit(False)
    start = F.when(seed.isNotNull(), F.least(F.greatest(F.round(d(seed)), lo0), hi0)) if seed is not None else null
    stride = F.when(d(seed).isNotNull(), d(step)) if seed is not None and step is not None else null
    none = F.array().cast("array<struct<value:double,score:double>>")
    before = dict(zip(STATE, (lo0, hi0, no, no, stride, null, null, null, no, no), strict=True)) | {"trials": none}
    packed = lambda fields: F.struct(*[c.alias(k) for k, c in fields.items()])

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def trial(s: Column, n: Column) -> Column:
        setting, grown = proposed(COLUMNS, s, n == 1, (n == trials) & (n > 1), start, hi0, geometric)
        return let(packed({"v": d(setting), "step": d(grown)}), lambda t: let(packed({"v": t["v"], "step": t["step"], "s": d(score(t["v"]))}), lambda x: after(s, x)))

    def after(s: Column, x: Column) -> Column:
        log = F.concat(s["trials"], F.array(F.struct(x["v"].alias("value"), x["s"].alias("score"))))
        return packed(judged(COLUMNS, s, x["v"], x["step"], x["s"], target, tolerance) | {"trials": log})

    def finish(s: Column) -> Column:
        capped = ~s["best_reaches"] & F.exists(s["trials"], lambda t: t["value"] == hi0)
        return F.struct(s["best"].alias("value"), s["best_score"].alias("score"), F.size(s["trials"]).alias("iterations"), s["best_reaches"].alias("reached"), capped.alias("capped"), s["trials"].alias("trials"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(trials)), packed(before), lambda s, n: F.when(s["done"], s).otherwise(trial(s, n)), finish)


def half_up(x: float) -> float:
    """Rounded, halves away from zero."""
    return math.copysign(math.floor(abs(x) + 0.5), x)


@dataclass
class Found:
    value: float
    score: float
    output: object
    reached: bool
    capped: bool
    trials: list[tuple[float, float, int]] = field(default_factory=list)


def search(run: Callable[[float], tuple[object, float, int]], target: float, *, tolerance: float = TOLERANCE, trials: int = TRIALS, floor: float = QUALITY[0], ceiling: float = QUALITY[1], seed: float | None = None, step: float | None = None, geometric: bool = False) -> Found:
    """As search_column(), by the same rules, where run(value) gives (output, score, size) of a trial."""
    low, top = half_up(floor), half_up(ceiling)
    start = None if seed is None else min(max(half_up(seed), low), top)
    state = dict(zip(STATE, (low, top, False, False, None if seed is None else step, None, None, None, False, False), strict=True))
    log: list[tuple[float, float, int]] = []
    kept: object = None
    while not state["done"] and len(log) < trials:
        n = len(log) + 1
        setting, grown = proposed(NUMBERS, state, n == 1, 1 < n == trials, start, top, geometric)
        output, score, size = run(setting)
        log.append((setting, score, size))
        state = judged(NUMBERS, state, setting, grown, score, target, tolerance)
        if state["best"] == setting:
            kept = output
    capped = not state["best_reaches"] and any(v == top for v, _, _ in log)
    return Found(state["best"], state["best_score"], kept, state["best_reaches"], capped, log)
