"""A PySpark engine for source-code metadata.

Scans source trees, extracts annotations, symbols, calls, imports, doc
comments and version-control facts into typed tables, and answers questions
about them with DataFrame operators.
"""
