"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
