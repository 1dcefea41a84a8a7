"""Training-data operators over document, embedding and page tables.

Every module here holds one operator with a general interface and a thin ``query`` that applies it to the whole of
its intended table.  Nothing outside this subpackage imports it.
"""
