"""Operators for building training corpora; nothing else in strandloom imports this subpackage."""
