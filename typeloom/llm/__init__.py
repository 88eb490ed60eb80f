"""Training-data pipeline operators: ten corpus operators and their queries.

Nothing outside this subpackage imports it, apart from the guarded hook in
``__spark_entry__.py`` and ``corpus_pipeline.py`` at the repository top.
"""
