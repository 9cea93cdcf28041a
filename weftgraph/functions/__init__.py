"""Scalar expressions: functions from Columns to Columns."""
