"""Whole plans and the catalogue of registered queries."""
