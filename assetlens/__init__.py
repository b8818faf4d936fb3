"""Analytics of equipment registers on PySpark."""

from assetlens.operators.derive import derived
from assetlens.operators.filters import FilterSpec, apply_filters
from assetlens.plans.dashboard import Dashboard, dashboard
from assetlens.plans.load import load_sheet, open_workbook
from assetlens.plans.register import Register
from assetlens.session import build_session

__all__ = [
    "Dashboard",
    "FilterSpec",
    "Register",
    "apply_filters",
    "build_session",
    "dashboard",
    "derived",
    "load_sheet",
    "open_workbook",
]
