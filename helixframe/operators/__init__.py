"""Operators over tables of texts: DataFrames in, DataFrames out.

Texts come as (file_id, text) rows. Positions count characters from 0. Three kinds
of coordinates are told apart by name: `orig` (the text as it is), `nohdr` (without
header lines) and `seq` (without header lines and line feeds).
"""
