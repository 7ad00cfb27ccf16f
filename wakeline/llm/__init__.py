"""Corpus preparation operators for language-model training data.

Nothing outside this subpackage imports it; `wakeline.llm.queries` holds the
registered queries and their SQL.
"""
