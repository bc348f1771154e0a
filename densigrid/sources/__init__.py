"""Reading and writing rows, goals, records and payloads."""
