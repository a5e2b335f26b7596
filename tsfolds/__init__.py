"""tsfolds: time-series panels and walk-forward analysis on Spark.

Operators live in ``tsfolds.operators`` (DataFrame -> DataFrame functions),
sources and stores in ``tsfolds.sources``, expression helpers in
``tsfolds.functions``, skew-proof window plans, fixtures, the feature graph
and the registered queries in ``tsfolds.plans``, and the streaming operators
in ``tsfolds.streaming``.
"""

__version__ = "0.1.0"
