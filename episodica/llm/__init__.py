"""Operators for large text corpora: sharding, token files, language, duplicates, personal data, packing.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface; ``queries``
applies them to the driver's tables.
"""
