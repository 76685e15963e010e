"""Random draws as pure functions of (seed, ..., key).

Every draw is a slice of an md5 digest, so a retried task, another partition
count or another engine gets the same number.
"""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 2**32


def digest(*parts) -> Column:
    """md5 of the parts joined by ':' as 32 hex digits."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def word(hexdigest: Column, index: int = 0) -> Column:
    """The index-th 32-bit word (0 to 3) of a digest as a bigint."""
    return F.conv(F.substring(hexdigest, 1 + 8 * index, 8), 16, 10).cast("bigint")


def draw(*parts) -> Column:
    """A 32-bit integer drawn for the given parts."""
    return word(digest(*parts))


def uniform(hexdigest: Column, index: int = 0) -> Column:
    """A double in [0, 1) from one word of a digest."""
    return word(hexdigest, index) / F.lit(float(WORD))


def chance(hexdigest: Column, rate: float) -> Column:
    """``uniform(hexdigest) < rate``, decided on the hex digits without converting them."""
    bound = math.ceil(rate * WORD)
    if bound >= WORD:
        return F.lit(True)
    return F.substring(hexdigest, 1, 8) < F.lit(f"{max(bound, 0):08x}")


def order(*parts, digits: int = 8) -> Column:
    """Leading hex digits of a digest; they sort like the number they spell."""
    return F.substring(digest(*parts), 1, digits)


def row_key(cols) -> Column:
    """The key columns of a row as one string, different for different keys.

    One column is spelled as it is.  Several are joined by ``:``, with ``\\`` before a ``:`` or ``\\`` of a
    value and ``\\N`` for null.
    """
    cells = [F.col(c).cast("string") for c in cols]
    if len(cells) == 1:
        return F.coalesce(cells[0], F.lit("\\N"))
    escaped = [F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")) for c in cells]
    return F.concat_ws(":", *[F.coalesce(c, F.lit("\\N")) for c in escaped])
