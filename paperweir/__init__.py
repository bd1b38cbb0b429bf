"""Spark engine for document retrieval, citation analytics and corpus preparation."""
