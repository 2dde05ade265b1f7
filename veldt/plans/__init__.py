"""Analytical views and the registered queries."""
