"""Report and job definitions, one module per domain. Every function is lazy:
``f(tables, *, as_of/now/run_ts, ...) -> DataFrame``, no collect, no clock."""
