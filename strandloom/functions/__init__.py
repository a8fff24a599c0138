"""Column functions: sequences, identifiers and scalar maths, all inside code generation or higher-order functions."""
