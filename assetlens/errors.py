"""Errors a caller can act on; all are raised before any Spark job starts."""

from __future__ import annotations


class AssetLensError(Exception):
    """Base class."""


class ModelColumnMissing(AssetLensError):
    """The register has no column that can play the model role."""


class SearchPatternError(AssetLensError):
    """The search text is not a valid regular expression."""


class HeaderRowError(AssetLensError):
    """A manual header row lies outside the allowed range."""


class SheetNotFound(AssetLensError):
    """The workbook has no readable sheet of that name."""


class SeveralWorkbooks(ValueError):
    """A path that should name one workbook holds more."""
