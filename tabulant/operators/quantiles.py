"""Exact medians of many columns without sorting, exploding or collecting the data.

A scan makes one mergeable rank sketch (KLL: Karnin, Lang and Liberty, 2016) per column of the values in an interval, and
counts those below it.  The sketch knows every rank to within a share of ``ERROR``, so the quantiles
on either side of the wanted rank bracket it, and the next scan looks at the values between them only.  A sketch that has
seen at most ``SKETCH`` values still holds all of them and decides.  The interval shrinks to about ``2 * ERROR`` of its rows
each time: two scans do for millions of rows, four for 10^12, whatever the number of columns.

The counts show whether a bracket holds its rank; the rare one that does not is taken back and made wider.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.sources.scratch import discard, materialize

SKETCH = 8192
ERROR = 0.001  # about three times the sketch's rank error at 99 % confidence


@dataclass
class Search:
    """A column, the ranks wanted of all its values, and the interval that is looked at."""

    name: str
    ranks: tuple = ()
    low: float | None = None
    high: float | None = None
    error: float = ERROR
    safe: tuple = (None, None)  # an interval that is known to hold the ranks

    def values(self) -> Column:
        x = _number(self.name)
        return x if self.low is None else F.when(x.between(self.low, self.high), x)

    def aggregates(self, i: int) -> list[Column]:
        x, inside = _number(self.name), self.values()
        below = F.count(F.when(x < self.low, x)) if self.low is not None else F.lit(0)
        parts = {"below": below, "n": F.count(inside), "min": F.min(inside), "max": F.max(inside)}
        return [*[v.alias(f"{k}{i}") for k, v in parts.items()], F.kll_sketch_agg_double(inside, F.lit(SKETCH)).alias(f"sketch{i}")]

    def quantiles(self, i: int, below: int, n: int) -> list[Column]:
        """The bracket of the wanted ranks, and the values at these ranks, by what the sketch knows."""
        first, second = ((r - below + 0.5) / n for r in self.ranks)
        shares = {"low": first - self.error, "high": second + self.error, "first": first, "second": second}
        kept = {k: F.lit(min(1.0, max(0.0, v))) for k, v in shares.items()}
        return [F.kll_sketch_get_quantile_double(F.col(f"sketch{i}"), v).alias(f"{k}{i}") for k, v in kept.items()]


def medians(df: DataFrame, cols) -> dict[str, float]:
    """Median per column; the mean of the two middle values for an even count.  Nulls and NaNs are left out."""
    pending, found = [Search(name) for name in dict.fromkeys(cols)], {}
    while pending:
        sums = df.agg(*[a for i, s in enumerate(pending) for a in s.aggregates(i)])
        sums, path = materialize(sums, "sketches")  # one row: a sketch takes its ranks as literals, known after the counts
        counts = sums.select(*[c for c in sums.columns if not c.startswith("sketch")]).first()
        going, asked = [], []
        for i, s in enumerate(pending):
            below, n, least, most = (counts[f"{k}{i}"] for k in ("below", "n", "min", "max"))
            if not s.ranks:
                if n == 0:
                    raise ValueError(f"column {s.name!r} has no values")
                if math.isinf(least) or math.isinf(most):
                    raise ValueError(f"column {s.name!r} holds infinite values")
                s.ranks = ((n - 1) // 2, n // 2)
            if not below <= s.ranks[0] <= s.ranks[1] < below + n:
                s.low, s.high, s.error = *s.safe, 4 * s.error
                going.append(s)
            elif least == most:
                found[s.name] = least
            else:
                asked.append((i, s, below, n, least, most))
        values = sums.select(*[q for i, s, below, n, *_ in asked for q in s.quantiles(i, below, n)]).first()
        for i, s, _, n, least, most in asked:
            low, high = values[f"first{i}"], values[f"second{i}"]
            if n <= SKETCH:
                found[s.name] = low / 2 + high / 2 if low != high else low
                continue
            s.safe = least, most
            s.low, s.high = max(least, values[f"low{i}"]), min(most, values[f"high{i}"])
            going.append(s)
        discard(df.sparkSession, path)
        pending = going
    return {name: found[name] for name in cols}


def _number(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)
