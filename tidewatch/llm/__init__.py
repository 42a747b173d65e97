"""Training-data operators: extraction, scans, deduplication, scoring, search and mixing.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``entries`` maps the registered queries onto the tables.
"""
