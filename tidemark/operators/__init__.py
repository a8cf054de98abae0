"""Operators: functions from DataFrames to DataFrames over long tables keyed by asset and date."""
