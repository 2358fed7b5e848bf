"""Training-data operators over documents, embeddings and conversations.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
