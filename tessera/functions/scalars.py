"""Scalar functions over columns: labels, errors, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the proxy buckets and their labels (fixed values).
PROXY_BUCKETS = ((31, "[1,31]"), (63, "[32,63]"), (127, "[64,127]"), (255, "[128,255]"), (511, "[256,511]"))
PROXY_REST = "[512+]"


def proxy_label(proxy: Column) -> Column:
    """Bucket of a routing cost; what is below 1 falls into the first."""
    out = None
    for top, name in PROXY_BUCKETS:
        out = F.when(proxy <= top, F.lit(name)) if out is None else out.when(proxy <= top, F.lit(name))
    return out.otherwise(F.lit(PROXY_REST))


def relative_error(estimate: Column, truth: Column) -> Column:
    """abs(estimate - truth) / abs(truth); with truth 0: 0 if the estimate is 0 too, else infinite."""
    e, t = estimate.cast("double"), truth.cast("double")
    return F.when(t == 0, F.when(e == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.abs(e - t) / F.abs(t))


def bias(estimate: Column, truth: Column) -> Column:
    """estimate - truth; its absolute value is the other report's bias."""
    return estimate.cast("double") - truth.cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))


def percent(x: Column, digits: int) -> Column:
    """A share as a percent string; infinite shares as inf, null as an empty string."""
    return F.when(x.isNull(), F.lit("")).when(x == float("inf"), F.lit("inf")).otherwise(F.format_string(f"%.{digits}f%%", x.cast("double") * 100))


def times(x: Column) -> Column:
    """A speed-up with its sign, as 1.50x; null as an empty string."""
    return F.when(x.isNull(), F.lit("")).otherwise(F.format_string("%.2fx", x.cast("double")))


def verdict(hybrid: Column, exact: Column, ordered: Column, sketch: Column) -> Column:
    """GO, MARGINAL or NO-GO: hybrid is over 1.5 times as fast as exact, beats the sorted run's speed-up, and takes less than the all-sketch run."""
    speed = exact / hybrid
    passed = (speed > 1.5).cast("int") + (speed > F.when(ordered > 0, exact / ordered).otherwise(F.lit(0.0))).cast("int") + (hybrid < sketch).cast("int")
    return F.when(passed == 3, "GO").when(passed == 2, "MARGINAL").otherwise("NO-GO")
