"""framewright: pipeline operators for tables, written as Spark DataFrame functions."""
