"""Configuration, run stages, clocks and frame sinks."""
