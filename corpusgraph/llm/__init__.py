"""Operators of a training-data pipeline over a ``documents`` table.

Every operator takes a DataFrame that has at least the columns it names
(``doc_id``, ``text``) and ignores all others, so extra columns with any name
are harmless.  A null text is treated as an empty one.
"""
