"""Chains of operators, and queries made of them."""
