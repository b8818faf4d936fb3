"""Registers, grids and workbooks derived from the star-schema tables, queries and their SQL."""
