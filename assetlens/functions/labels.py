"""Category labels of warranty and age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and limits of the two classifications.
WARRANTY_LABELS = ["Expired", "Expiring Soon", "Active", "Unknown"]
EXPIRING_WITHIN_DAYS = 90
AGE_LABELS = ["New (0-1 year)", "Active (1-3 years)", "Aging (3-5 years)", "Old (5+ years)"]
AGE_LIMITS = [1, 3, 5]


def warranty_label(days: Column) -> Column:
    """Label for days to expiry; NULL is Unknown."""
    expired, soon, active, unknown = WARRANTY_LABELS
    return (
        F.when(days.isNull(), unknown)
        .when(days < 0, expired)
        .when(days <= EXPIRING_WITHIN_DAYS, soon)
        .otherwise(active)
    )


def age_label(age: Column) -> Column:
    """Label for an age in years."""
    new, active, aging, old = AGE_LABELS
    one, three, five = AGE_LIMITS
    return (
        F.when(age <= one, new)
        .when(age <= three, active)
        .when(age <= five, aging)
        .when(age > five, old)
    )
