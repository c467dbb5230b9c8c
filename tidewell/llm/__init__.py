"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  ``queries`` holds the registered
queries and their SQL; each other module holds one operator.
"""
