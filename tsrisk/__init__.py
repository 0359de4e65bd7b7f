"""PySpark analytics over large tables of timestamped, located, categorised incidents."""
