"""Column-level functions: the filter language and scalar formatters."""
