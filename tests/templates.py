"""Five sample rows per kind of register, with the headers a person would type."""

from __future__ import annotations

AS_OF = "2025-06-15 10:30:00"

WORKSTATION_HEADERS = [
    "Asset Tag", "Model", "Workstation Type", "Serial Number", "User", "User Email",
    "Department", "Location", "Site", "Year Of Purchase", "Warranty Expiry", "Place",
    "Workstation Status", "State",
]
WORKSTATION_ROWS = [
    ("WS001", "Laptop A", "Laptop", "SN1", "Ann", "ann@company.com", "IT", "HQ A",
     "Headquarters", "2022", "2025-12-31", "Malaysia", "Active", "In Use"),
    ("WS002", "Laptop B", "Laptop", "SN2", "Ben", "ben@company.com", "Finance", "HQ B",
     "Headquarters", "2021", "2024-11-30", "Malaysia", "Active", "In Use"),
    ("WS003", "Laptop C", "Laptop", "SN3", "Cem", "cem@company.com", "HR", "Branch",
     "Branch", "2023", "2026-06-30", "Singapore", "Active", "In Use"),
    ("WS004", "Desktop D", "Desktop", "SN4", "Dee", "dee@company.com", "Operations", "HQ A",
     "Headquarters", "2020", "2023-10-31", "Malaysia", "Retired", "Storage"),
    ("WS005", "Laptop E", "Laptop", "SN5", "Eva", "eva@company.com", "Marketing", "Remote",
     "Remote", "2022", "2025-08-15", "Malaysia", "Active", "In Use"),
]

MOBILE_HEADERS = [
    "Asset Tag", "Product", "Product Type", "Serial Number", "User", "User Email",
    "Department", "Location", "Site", "Year Of Purchase", "Programme", "State",
]
MOBILE_ROWS = [
    ("MB001", "Phone A", "Phone", "SM1", "Ann", "ann@company.com", "IT", "HQ A",
     "Headquarters", "2022", "Enterprise", "In Use"),
    ("MB002", "Phone B", "Phone", "SM2", "Ben", "ben@company.com", "Sales", "Field",
     "Field", "2021", "Sales", "In Use"),
    ("MB003", "Tablet C", "Tablet", "SM3", "Cem", "cem@company.com", "Operations", "HQ B",
     "Headquarters", "2023", "Operations", "In Use"),
    ("MB004", "Phone D", "Phone", "SM4", "Dee", "dee@company.com", "Finance", "HQ A",
     "Headquarters", "2021", "Finance", "In Use"),
    ("MB005", "Tablet E", "Tablet", "SM5", "Eva", "eva@company.com", "HR", "Branch",
     "Branch", "2022", "HR", "In Use"),
]


def table(spark, headers, rows):
    """Text columns under any headers, also ones that differ in case only."""
    schema = ", ".join(f"_{i} string" for i in range(len(headers)))
    return spark.createDataFrame(list(rows), schema).toDF(*headers)
