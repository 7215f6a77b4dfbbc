"""Operators of a training-data pipeline (dedup, search, scoring, tokens, shards).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when it can be imported."""
