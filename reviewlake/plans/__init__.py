"""Jobs that are composed of operators."""
