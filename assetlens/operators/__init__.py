"""Operators over registers and over raw grids."""
