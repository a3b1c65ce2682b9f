"""Column functions: everything here is an expression over columns, or a table made on the driver."""
