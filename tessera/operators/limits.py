"""Circuit breakers, token buckets and moving averages as ordered folds over a key's rows (see folds)."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.folds import Fold, folded

#: (rejected, state, failures, time of the last failure)
BREAKER = (0, "CLOSED", 0, 0.0)


def breaker_next(state: tuple, at: float, ok: bool, threshold: int, recovery: float) -> tuple:
    """The breaker after one more call: closed, open from the threshold of failures on, half open once it has recovered."""
    rejected, name, failures, last = state
    if name == "OPEN" and at - last <= recovery:
        return rejected + 1, name, failures, last
    if ok:
        return rejected, "CLOSED", 0, last
    return rejected, ("OPEN" if name == "OPEN" or failures + 1 >= threshold else "CLOSED"), failures + 1, float(at)


def breaker_summary(at: list[float], ok: list[bool], threshold: int, recovery: float) -> tuple[list, list, float | None]:
    """Where the breaker is behind some calls in order, for each state before them: closed after 0, 1, ... failures, and open.

    The latter as (time, place) by ascending time: the place holds for last failures up to the recovery before the time's call,
    and from the one before on. A place is (state, failures, whether they add to those before, time of the last failure).
    """
    n, trip = len(at), max(1, threshold)
    oks = [k for k in range(n) if ok[k]]
    longs = []  # starts of runs of failures that open a closed breaker
    for a, b in zip([-1, *oks], [*oks, n], strict=True):
        if b - a - 1 >= trip:
            longs.append(a + 1)

    def after(k: int) -> int:
        """The first call that an open breaker lets through whose last failure is call k."""
        j = bisect_right(at, at[k] + recovery, k + 1)
        while j < n and at[j] - at[k] <= recovery:
            j += 1
        while j > k + 1 and at[j - 1] - at[k] > recovery:
            j -= 1
        return j

    def closed(k: int, failures: int) -> tuple[int, tuple | None]:
        """From call k on, closed after so many failures: the call that opens the breaker, or n and the place at the end."""
        first = oks[i] if (i := bisect_left(oks, k)) < len(oks) else n
        need = max(1, threshold - failures)
        if first - k >= need:
            return k + need - 1, None
        if first == n:
            return n, ("CLOSED", failures + n - k, False, 0.0)
        i = bisect_left(longs, first + 1)
        if i < len(longs):
            return longs[i] + trip - 1, None
        return n, ("CLOSED", n - 1 - oks[-1], False, 0.0)

    known: dict[int, tuple] = {}

    def tried(j: int) -> tuple:
        """The place at the end if an open breaker lets call j through."""
        path = []
        while j not in known:
            if ok[j]:
                opens, place = closed(j + 1, 0)
                if place is None:
                    following = after(opens)
                    if following < n:
                        path.append((j, trip, False))
                        j = following
                        continue
                    place = ("OPEN", trip, False, at[opens])
                known[j] = place
            else:
                following = after(j)
                if following < n:
                    path.append((j, 1, True))
                    j = following
                    continue
                known[j] = ("OPEN", 1, True, at[j])
        place = known[j]
        for k, failures, adds in reversed(path):
            name, more, relative, last = place
            place = known[k] = (name, failures + more, adds, last) if relative else place
        return place

    def from_closed(failures: int) -> tuple:
        opens, place = closed(0, failures)
        if place is not None:
            return place
        count = failures + opens + 1 if opens < (oks[0] if oks else n) else trip
        following = after(opens)
        if following == n:
            return ("OPEN", count, False, at[opens])
        name, more, relative, last = tried(following)
        return (name, count + more, False, last) if relative else (name, more, False, last)

    opened = []
    for j in range(min(n, after(0) + 1) if n else 0):
        place = tried(j)
        if not opened or opened[-1][1] != place:
            opened.append((at[j - 1] if j else None, place))
    return [from_closed(f) for f in range(trip)], opened, at[-1] if n else None


def breaker_follow(summary: tuple, state: tuple, recovery: float) -> tuple:
    rejected, name, failures, last = state
    closed, opened, end = summary
    if end is None or name == "OPEN" and end - last <= recovery:  # no call, or none that is let through
        return state
    if name == "CLOSED":
        place = closed[min(failures, len(closed) - 1)]
    else:
        place = [p for before, p in opened if before is None or before - last <= recovery][-1]
    now, more, adds, failed = place
    return rejected, now, failures + more if adds else more, failed


def breaker_fold(threshold: int, recovery: float) -> Fold:
    return Fold(
        BREAKER,
        lambda state, at, ok: breaker_next(state, at, ok, threshold, recovery),
        lambda values: breaker_summary([float(x) for x in values[0]], values[1], threshold, recovery),
        lambda summary, state: breaker_follow(summary, state, recovery),
        1,
    )


def breaker_states(calls: DataFrame, key: str, at: str, order: str, threshold: int = 10, recovery: float = 30.0, **size: int) -> DataFrame:
    """(key, state, failures, rejected) after all calls with a boolean ``ok``, times in seconds."""
    out = folded(calls, key, [at, order], [at, "ok"], breaker_fold(threshold, recovery), "rejected int, state string, failures int", **size)
    return out.select(key, "state", "failures", "rejected")


#: (calls that waited, seconds waited, tokens, time of the last call's leave); a bucket of ``capacity`` starts full.
def bucket_start(capacity: float) -> tuple:
    return 0, 0.0, float(capacity), 0.0


def bucket_next(state: tuple, called: float, fill: float, capacity: float) -> tuple:
    """The bucket after one more call, which waits until there is a token."""
    delayed, waited, tokens, then = state
    now = max(called, then)
    have = min(capacity, tokens + max(0.0, now - then) * fill)
    wait = (1.0 - have) / fill if have < 1.0 else 0.0
    return delayed + (have < 1.0), waited + wait + (now - called), max(have - 1.0, 0.0), now + wait


def bucket_summary(called: list[float], fill: float, capacity: float) -> tuple[int, float, float]:
    """Of calls in order: how many, the latest moment at which the bucket is empty behind them if that follows from them alone, and the last call.

    The moment at which the bucket was or will be empty moves by one token's time with each call, and is never more than a full bucket's
    time before a call; both are kept by adding and by the larger of two, so any number of calls are one such step.
    """
    each, whole = 1.0 / fill, capacity / fill
    return len(called), max(accumulate(called, lambda empty, at: max(empty, max(at, 0.0) - whole) + each, initial=float("-inf"))), called[-1]


def bucket_follow(summary: tuple[int, float, float], state: tuple, fill: float) -> tuple:
    n, empty, last = summary
    delayed, waited, tokens, then = state
    empty = max(then - tokens / fill + n / fill, empty)
    now = max(last, empty, 0.0)
    return delayed, waited, (now - empty) * fill, now


def bucket_waits(calls: DataFrame, key: str, at: str, order: str, fill: float, capacity: float, **size: int) -> DataFrame:
    """(key, delayed, waited): calls that waited for a token, and seconds waited, with a bucket that starts full."""
    fold = Fold(
        bucket_start(capacity),
        lambda state, called: bucket_next(state, called, fill, capacity),
        lambda values: bucket_summary([float(x) for x in values[0]], fill, capacity),
        lambda summary, state: bucket_follow(summary, state, fill),
        2,
    )
    return folded(calls, key, [at, order], [at], fold, "delayed int, waited double", **size).withColumn("waited", F.round("waited", 3))


def average_next(state: tuple, x: float, weight: float) -> tuple:
    """The average after one more value: the first, and any after an average of zero, starts it anew."""
    return (x if state[0] == 0.0 else weight * x + (1 - weight) * state[0],)


def average_summary(values: list[float], weight: float) -> tuple[float, float, float]:
    """(z, a, b): the average behind these values is z from zero on, else a * average + b.

    Once nothing is left of the average before them, the values alone decide, a is 0.
    """
    zero, a, b = 0.0, 1.0, 0.0
    for x in values:
        zero = average_next((zero,), x, weight)[0]
        if a == 0.0:
            b = average_next((b,), x, weight)[0]
        else:
            a, b = (1 - weight) * a, weight * x + (1 - weight) * b
            if a == 0.0 and b == 0.0:
                b = zero
    return zero, a, b


def moving_average(rows: DataFrame, key: str, order: str, value: str, weight: float = 0.2, **size: int) -> DataFrame:
    """(key, ema): exponential average in order; the first value, and any after an average of zero, starts it anew."""
    fold = Fold(
        (0.0,),
        lambda state, x: average_next(state, x, weight),
        lambda values: average_summary(values[0], weight),
        lambda summary, state: (summary[0] if state[0] == 0.0 else summary[1] * state[0] + summary[2],),
    )
    return folded(rows, key, [order], [value], fold, "ema double", **size).withColumn("ema", F.round("ema", 6))
