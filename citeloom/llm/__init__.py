"""Operators for preparing language-model training data, each a lazy DataFrame function.

Nothing outside this package imports it; ``llm.registry`` lists its queries.
"""
