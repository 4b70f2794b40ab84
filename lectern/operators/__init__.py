"""Operators: functions from DataFrames to DataFrames, for ``DataFrame.transform`` or plain calls."""
