"""outlog: find unusual log lines with Spark DataFrames.

Log text is reduced to templates, templates are embedded by the lines around them, a
self-organising map (or k-means / local outlier factor) is fitted as distributed Spark jobs,
every line is scored against it and lines beyond a learned threshold are flagged.
"""
__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python workers on executors may not have this package installed: let Spark's
    pickler send outlog's functions by value with each task instead of by import path."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older pickler: ship the package with --py-files
        pass


_ship_by_value()
