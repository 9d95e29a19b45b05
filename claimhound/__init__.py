"""Claims-fraud analytics as plain PySpark DataFrame functions."""
