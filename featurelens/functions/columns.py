"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the analysed program's -----------------
# Short month names used for month labels (index 1..12).
MONTH_SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Mood quadrant labels: (high valence, high energy), (low, high), (high, low), (low, low).
QUADRANT_LABELS = ["Happy & Intense", "Dark & Intense", "Happy & Calm", "Dark & Calm"]
# Trend arrows: rising, falling, flat; and the text used when undefined.
ARROW_UP, ARROW_DOWN, ARROW_FLAT, NOT_AVAILABLE = "↑", "↓", "→", "N/A"
# Link patterns: collection id in a collection link, item id in an item link.
COLLECTION_LINK_PATTERN = r"playlist/([A-Za-z0-9]+)"
ITEM_LINK_PATTERN = r"track/([A-Za-z0-9]+)"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, n: int) -> Column:
    """Round like numpy/pandas: half-to-even on the scaled binary value.

    ``bround(x * 10^n, 0) / 10^n`` gives the same double as
    ``rint(x * 10^n) / 10^n``; DuckDB's ``round_even(x * 1eN, 0) / 1eN`` matches.
    """
    c = _c(c)
    if n == 0:
        r = F.bround(c, 0)
    else:
        scale = float(10 ** n)
        r = F.bround(c * F.lit(scale), 0) / F.lit(scale)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)  # -0.0 -> 0.0


def null_if_nan(c) -> Column:
    """NaN -> NULL so Spark's null-skipping aggregates behave like pandas."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def to_double_array(c) -> Column:
    return F.transform(_c(c), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sum of element products, folded left to right."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b, zero_norm: float = 0.0) -> Column:
    """Cosine similarity of two double arrays; ``zero_norm`` when either is zero."""
    denom = norm(a) * norm(b)
    return F.when(denom == 0, F.lit(float(zero_norm))).otherwise(dot(a, b) / denom)


def collection_id(s, pattern: str = COLLECTION_LINK_PATTERN, uri_prefix: str = "urn:") -> Column:
    """Id from a URI (``<prefix>...:<id>``), a link matching ``pattern``, or the trimmed input."""
    s = _c(s)
    hit = F.regexp_extract(s, pattern, 1)
    return (F.when(s.startswith(uri_prefix), F.substring_index(s, ":", -1))
            .when(hit != "", hit)
            .otherwise(F.trim(s)))


def link_id(s, pattern: str = ITEM_LINK_PATTERN) -> Column:
    """Id captured from a link; NULL when the link does not match."""
    hit = F.regexp_extract(F.coalesce(_c(s), F.lit("")), pattern, 1)
    return F.when(hit != "", hit)


def safe_name(s, max_len: int = 40) -> Column:
    """Keep letters, digits, space, '_' and '-'; cut to ``max_len``; trim."""
    kept = F.regexp_replace(_c(s), r"[^\p{L}\p{N} _-]", "")
    return F.trim(F.substring(kept, 1, max_len))


def month_short(m) -> Column:
    return F.get(F.array(*[F.lit(x) for x in MONTH_SHORT]), _c(m) - 1)


def trend_arrow(diff, threshold: float = 0.02) -> Column:
    """'<arrow> <|diff| with 2 decimals>', or N/A when the difference is undefined."""
    d = _c(diff)
    arrow = (F.when(d > threshold, F.lit(ARROW_UP))
             .when(d < -threshold, F.lit(ARROW_DOWN))
             .otherwise(F.lit(ARROW_FLAT)))
    text = F.concat(arrow, F.lit(" "), F.format_string("%.2f", rnd(F.abs(d), 2)))
    return F.when(d.isNull(), F.lit(NOT_AVAILABLE)).otherwise(text)


def quadrant(x, y, mid: float = 0.5) -> Column:
    """Mood quadrant from x (valence-like) and y (energy-like), split at ``mid``."""
    x, y = _c(x), _c(y)
    return (F.when((x >= mid) & (y >= mid), F.lit(QUADRANT_LABELS[0]))
            .when((x < mid) & (y >= mid), F.lit(QUADRANT_LABELS[1]))
            .when((x >= mid) & (y < mid), F.lit(QUADRANT_LABELS[2]))
            .otherwise(F.lit(QUADRANT_LABELS[3])))
