"""Training-data operators: search, archives, filters, de-duplication, packing, mixing.

Nothing outside this subpackage imports it; its queries live in ``queries.py``.
"""
