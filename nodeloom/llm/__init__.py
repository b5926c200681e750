"""Training-data preparation operators: dedup, language id, extraction, mixing, tokenising, WARC.

Nothing else in the library imports this subpackage.
"""
