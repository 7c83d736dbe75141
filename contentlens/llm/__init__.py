"""Operators for preparing large language-model training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``registry`` holds the registered queries.
"""
