"""Operators for building text training sets: matching, cleaning, scoring, packing.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
with at least ``doc_id`` and ``text`` (other columns are ignored, whatever their
names) and declares in its docstring what it does with nulls, empty and very
long texts, ties and repeated rows.
"""
