"""Operators for preparing large text collections.

Every module holds one operator with a general interface over DataFrames;
``queries`` derives the digest columns of the registered queries from them.
Nothing outside this subpackage imports it.
"""
