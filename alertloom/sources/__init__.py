"""Readers. Each returns DataFrames and runs no job unless it says so."""
