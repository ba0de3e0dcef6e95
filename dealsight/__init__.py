"""dealsight: deal-intelligence analytics expressed as Spark DataFrame jobs.

Every operator is ``f(DataFrame..., as_of, params) -> DataFrame``: no globals,
no wall clock, no collect.  Batch and stream share the same Column helpers.
"""
