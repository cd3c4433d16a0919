"""Column functions over text; all run inside the JVM unless their docstring says otherwise."""
