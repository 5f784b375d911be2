"""Job plans: the ETL and the registry of named queries."""
