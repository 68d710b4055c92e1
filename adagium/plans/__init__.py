"""Registered queries: compositions of the operators over tables."""
