"""netpulse: network-telemetry analytics on Spark."""

# Functions of this package that run inside tasks (mapInPandas / applyInPandasWithState)
# are shipped by value, so executors do not need the package installed.
try:
    from pyspark import cloudpickle as _cloudpickle
    import sys as _sys

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
