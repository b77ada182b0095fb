"""Rule columns: drift arithmetic, severities, score bands, cycle keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status and severity names, default thresholds.
OK, WARNING, CRITICAL = "OK", "WARNING", "CRITICAL"
BASELINE_MISSING = "BASELINE_MISSING"
DEFAULT_WARNING, DEFAULT_CRITICAL = 0.10, 0.30
SEVERITY_RANKS = {"OK": 0, "WARNING": 1, "CRITICAL": 2}


def as_column(value) -> Column:
    """A Column as is, a string as a column name."""
    return F.col(value) if isinstance(value, str) else value


def as_number(value) -> Column:
    """A Column as is, a plain number as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def absolute_diff(baseline, current) -> Column:
    return F.abs(as_column(current) - as_column(baseline))


def relative_diff(baseline, current) -> Column:
    """|current - baseline| over |baseline|; a zero baseline yields the absolute difference."""
    base = as_column(baseline)
    diff = absolute_diff(base, current)
    return F.when(base == 0, diff).otherwise(diff / F.abs(base))


def classify_drift(relative, warning=DEFAULT_WARNING, critical=DEFAULT_CRITICAL) -> Column:
    """NULL and values under ``warning`` are OK; thresholds may be numbers or Columns."""
    rel = as_column(relative)
    return (
        F.when(rel.isNull() | (rel < as_number(warning)), OK)
        .when(rel < as_number(critical), WARNING)
        .otherwise(CRITICAL)
    )


def drift_status(baseline, relative, warning=DEFAULT_WARNING, critical=DEFAULT_CRITICAL) -> Column:
    return F.when(as_column(baseline).isNull(), BASELINE_MISSING).otherwise(
        classify_drift(relative, warning, critical)
    )


def severity(status) -> Column:
    """Trimmed upper-case severity; anything outside the three known names counts as OK."""
    name = F.upper(F.trim(as_column(status)))
    return F.when(name.isin(*SEVERITY_RANKS), name).otherwise(OK)


def severity_rank(status) -> Column:
    name = severity(status)
    return F.when(name == CRITICAL, 2).when(name == WARNING, 1).otherwise(0)


def minimum_rank(minimum: str | None) -> int:
    """Rank of a configured minimum severity; blank or unknown means WARNING."""
    return SEVERITY_RANKS.get((minimum or WARNING).strip().upper(), 1)


def minimum_rank_column(minimum) -> Column:
    """Column form of :func:`minimum_rank`."""
    name = F.upper(F.trim(as_column(minimum)))
    return F.when(name == CRITICAL, 2).when(name == OK, 0).otherwise(1)


def score_band(score, bands: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Label of the first band (highest bound first) the score reaches; NULL stays NULL."""
    value = as_column(score)
    result = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in sorted(bands, reverse=True):
        result = result.when(value >= bound, label)
    return result.otherwise(lowest)


def cycle_key(cycle, model, version, window_start, window_end, severity_col) -> Column:
    """``cycle|model|version|start|end|severity`` with NULL optional parts as empty text."""
    optional = [F.coalesce(as_column(c), F.lit("")) for c in (version, window_start, window_end, severity_col)]
    return F.concat_ws("|", as_column(cycle), as_column(model), *optional)


def printed(value) -> Column:
    """Text of a value inside a message; NULL prints as ``None``."""
    return F.coalesce(as_column(value).cast("string"), F.lit("None"))


def blank(text) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return F.coalesce(F.length(F.trim(as_column(text))) == 0, F.lit(True))
