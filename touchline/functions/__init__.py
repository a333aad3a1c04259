"""Column expressions: parsing, validation, derived match columns, labels."""
