"""Operators on data: state machines, steps, registries, reductions, observation."""
