"""What is decided on the driver before any row is read: grids, goals, rules."""
