"""Operators for building language-model training data.

Nothing outside this folder imports it; its queries are registered only where
the folder is present.
"""
