"""Ways in: workbooks and delimited text, both as grids of cells."""
