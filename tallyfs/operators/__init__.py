"""Analyses over an inventory: aggregates, top-k and the duplicate funnel."""
