"""Reading and writing tables, and the log of module results."""
