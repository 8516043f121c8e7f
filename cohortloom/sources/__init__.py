"""Reading and writing tables, files and load logs."""
