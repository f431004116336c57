"""Training-data operators: filters, joins, packing and search over documents and vectors.

Nothing outside this subpackage imports it; delete it and the rest still works.
"""
