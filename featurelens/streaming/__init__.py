from featurelens.streaming.landing import land_json  # noqa: F401
