"""Whole plans: the catalogue and the identification pipeline."""
