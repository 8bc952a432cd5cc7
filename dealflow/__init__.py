"""dealflow: Spark-native sales-pipeline analytics.

Every operator is a plain function ``DataFrame (+ params) -> DataFrame`` that
takes its column names as parameters, so steps chain with ``df.transform``.
The main entry points are available at the top level (loaded on first use):
``SalesAnalysis``, ``ingest``, ``ingest_rep_team``, ``prepare``, ``run_report``.
"""

__version__ = "0.1.0"

_LAZY = {
    "SalesAnalysis": "dealflow.plans.flow",
    "ingest": "dealflow.plans.flow",
    "ingest_rep_team": "dealflow.plans.flow",
    "prepare": "dealflow.plans.flow",
    "run_report": "dealflow.plans.report",
    "get_session": "dealflow.session",
}


def __getattr__(name):
    if name in _LAZY:
        import importlib
        return getattr(importlib.import_module(_LAZY[name]), name)
    raise AttributeError(f"module 'dealflow' has no attribute {name!r}")


__all__ = sorted(_LAZY)
