"""Analytic operators, DataFrame in and DataFrame out."""
