"""All queries of the training-data operators and of the pipeline."""

import corpus_pipeline
from tallowmere.llm import queries_corpus, queries_filters, queries_joins, queries_models, queries_pages, queries_tokens

MODULES = [queries_corpus, queries_filters, queries_joins, queries_models, queries_pages, queries_tokens]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
