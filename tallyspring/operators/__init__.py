"""Data-preparation operators on long tables."""
