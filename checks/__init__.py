"""Binding of the library to the supplied tables, and the SQL it is checked against."""
