"""Training-data operators: ten operators over documents, pages and embeddings.

Nothing else in the library imports this package; ``__spark_entry__`` adds its queries when it is present.
"""
