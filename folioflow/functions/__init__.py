"""Spreadsheet functions as native Spark columns."""
