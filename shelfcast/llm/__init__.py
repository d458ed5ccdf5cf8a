"""Operators of a training-data pipeline: documents, pages and embeddings in, decisions and figures out."""
