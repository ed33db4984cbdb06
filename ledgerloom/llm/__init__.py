"""Operations of a training-data pipeline, each on DataFrames of any size.

Nothing outside this package imports it; :mod:`ledgerloom.llm.entry` lists the
queries that ``__spark_entry__`` adds when the package is present.
"""
