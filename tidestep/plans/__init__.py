"""Worlds, systems, schedules, applications and their coupling."""
