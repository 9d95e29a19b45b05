"""The catalog of analyses by name, and the SQL each is checked against."""
