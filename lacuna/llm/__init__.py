"""Operators for preparing language-model training data.

Every module holds one operator with a general interface; ``queries`` derives
the digest columns of the registered queries from them.  Nothing outside this
subpackage imports it.
"""
