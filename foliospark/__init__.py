"""foliospark: document classification and field extraction as Spark jobs.

Column functions live in ``foliospark.functions``, DataFrame operators in ``foliospark.operators``,
readers and writers in ``foliospark.sources``, whole jobs in ``foliospark.plans`` and the streaming
entry points in ``foliospark.streaming``.
"""

__version__ = "0.1.0"
