"""Job-lifecycle state over event logs."""
