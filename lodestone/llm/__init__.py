"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``lodestone.llm.entries`` lists the
queries and their SQL twins.
"""
