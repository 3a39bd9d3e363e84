"""factweave: a Spark-first engine for reconciling facts drawn from documents.

Everything is a DataFrame plan.  ``functions`` holds Column -> Column building
blocks, ``operators`` DataFrame -> DataFrame steps, ``sources`` readers and
adapters, ``plans`` the query registry and the pipeline, ``streaming`` the
incremental variants.  ``llm`` is an optional subpackage of operators for text
corpora; nothing else imports it.
"""
