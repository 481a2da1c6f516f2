"""Operators for training-data pipelines over text corpora.

Each module holds one operator with its own general interface; ``queries``
registers one ``opN_<name>`` query per operator over the corpus tables.
Nothing outside this subpackage imports it.
"""
