"""The registered queries, their input and the SQL they are checked against."""
