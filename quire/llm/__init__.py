"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``quire.llm.queries`` lists the
registered queries and their SQL.
"""
