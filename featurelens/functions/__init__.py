from featurelens.functions.columns import (  # noqa: F401
    collection_id,
    cosine,
    dot,
    link_id,
    month_short,
    norm,
    null_if_nan,
    quadrant,
    rnd,
    safe_name,
    to_double_array,
    trend_arrow,
)
