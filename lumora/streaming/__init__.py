"""Event windows and row-wise operators, for tables and for streams alike."""
