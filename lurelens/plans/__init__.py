"""Whole analyses composed from the jobs: one lazy plan each."""
