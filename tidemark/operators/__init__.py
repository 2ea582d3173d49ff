"""Cleaning, validation, imputation and scoring operators on DataFrames."""
