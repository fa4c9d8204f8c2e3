"""Operators for preparing language-model training data, as DataFrame-in / DataFrame-out functions.

Nothing outside this subpackage imports it.
"""
