"""tidelog: a PySpark analytics engine for partitioned event logs."""
