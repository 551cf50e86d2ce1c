"""Training-data operators. Nothing outside this package, ``corpus_pipeline.py`` and the guarded
import in ``__spark_entry__.py`` refers to it."""
