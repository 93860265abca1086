"""Training-data operators: the ten corpus operators and their registered queries.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds
``queries()`` and ``oracle_sql()`` from :mod:`lorewright.llm.registry`.
"""
