"""Operators: functions from DataFrames to DataFrames, with explicit order keys wherever order matters."""
