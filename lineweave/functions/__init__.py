"""Column functions: text in, column out.  Everything here stays on the JVM unless its name ends in _udf."""
