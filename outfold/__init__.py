"""outfold: out-of-fold evaluation of regressions on Spark.

- ``outfold.sources``: typed table scans, the layout-attribute table, the
  checked prediction sink.
- ``outfold.functions``: column expressions (stateless fold hash, safe
  division, exact integer casts).
- ``outfold.operators``: folds, out-of-fold models (means, encodings,
  medians, least squares, GBT), held-out scoring, metrics, table checks,
  profiles and features.
- ``outfold.streaming``: held-out scoring over arriving files.
- ``outfold.plans``: the checked queries (Spark builder + DuckDB oracle).
"""

__version__ = "0.1.0"
