"""Query plans over the driver tables, with their SQL equivalents."""
