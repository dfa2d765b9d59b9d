"""Whole estimates and robustness runs composed from the operators."""
