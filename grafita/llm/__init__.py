"""Operations of a training-data pipeline over tables of documents, pages and vectors.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` of
``grafita.llm.registry`` list what ``__spark_entry__`` registers.
"""
