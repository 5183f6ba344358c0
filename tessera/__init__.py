"""Tessera: retrieval, corpus analytics and training-data preparation as Spark jobs."""
