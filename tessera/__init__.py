"""Part of tessera, a PySpark analytics library."""
