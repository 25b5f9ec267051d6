"""Compositions: presets, scans, lineage cuts, and the registered queries."""
