"""tarnline: document question-answering analytics as Spark jobs.

Layout
------
sources/    readers and derived views, the namespaced vector table
functions/  column expressions (text, vector, answer rules)
operators/  DataFrame -> DataFrame operators (retrieval, chunking, namespaces, evaluation, lint, agent)
plans/      registered queries with their oracle SQL
streaming/  incremental ingest on Structured Streaming
llm/        operators for training-data pipelines; nothing outside imports it
"""

__version__ = "0.1.0"
