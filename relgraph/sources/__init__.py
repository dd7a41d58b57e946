"""Readers, intermediate tables, derived graphs and exports."""
