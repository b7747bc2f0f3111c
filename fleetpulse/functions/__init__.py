"""Column expressions: sensor physics, array reshaping and test distributions."""
