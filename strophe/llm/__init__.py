"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`strophe.llm.queries` holds the thin queries.
"""
