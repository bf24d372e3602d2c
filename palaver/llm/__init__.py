"""Training-data operators: formatting, packing, decontamination, sharding, language
identification, line and document dedup, vector search, token counts and HTML extraction.

Each module holds one operator with a general DataFrame interface; ``queries`` holds the thin
registered queries.  Nothing else in the library imports this subpackage.
"""
