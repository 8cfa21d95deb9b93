"""Joins, filters and table upkeep the plans are composed of."""
