"""Text-corpus operators for training-data pipelines.

Every operator takes a DataFrame with a key and a text column, selects only the
columns it needs (so other columns, clashing names included, do no harm), reads
whole texts and returns one row per input row unless its docstring says otherwise.
"""
