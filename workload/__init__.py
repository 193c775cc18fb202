"""Check queries: inputs derived from the test tables, queries over them, SQL to compare with."""
