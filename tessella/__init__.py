"""Tessella: document-retrieval analytics and corpus operators as PySpark DataFrame jobs."""
