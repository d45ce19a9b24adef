"""Column builders: scalar functions of headlines, sources and releases."""
