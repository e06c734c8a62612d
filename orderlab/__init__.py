"""orderlab: demand, ordering and backtest analytics as Spark DataFrame operators.

Layout
------
sources/    scans and sinks (test-table adapter, CSV/JSON, config, fingerprints)
functions/  column-expression builders (rule tables, newsvendor cost, smoothing)
operators/  DataFrame -> DataFrame operators (clean, profile, demand, costs,
            forecast, scenarios, allocation, joint model, evaluation)
plans/      named end-to-end queries and their SQL oracles
streaming/  incremental (Structured Streaming) form of the demand aggregation
"""

__version__ = "0.1.0"
