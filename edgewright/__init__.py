"""Edgewright: decoding of sparse logic-level captures on Spark DataFrames."""
