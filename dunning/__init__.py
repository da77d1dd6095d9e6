"""dunning — failed-payment recovery analytics on Spark.

Layers (each a DataFrame -> DataFrame function, composed into one plan):

    payments -> features -> diagnosis -> policy -> execution -> outcomes -> metrics
                                                     ^
                       webhook envelopes -- verify / dedupe / match --> recovery log

Package layout:
    sources/    table contracts, the payments view over the driver tables, sinks
    functions/  column-expression helpers (hash buckets, HMAC, formatting)
    operators/  the layers: features, diagnosis, policy, execution, outcomes,
                metrics, audit, cases, evaluation, models, skew-safe joins
    streaming/  webhook envelopes as a Structured Streaming query
    plans/      registered queries + their DuckDB oracle SQL, the full run
"""

__version__ = "0.1.0"
