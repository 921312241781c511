"""Column functions: formats, names, templates, wire codecs."""
