"""A PySpark engine for street-level greenery, and operators for training corpora."""
