"""Training-data operators: quality, tokenisation, decontamination, de-duplication, search and storage.

Nothing else in the library imports this subpackage.
"""
