"""Training-data operators: ten corpus-scale stages beside the audit.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only when it can be imported.
"""
