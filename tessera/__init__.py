"""Retrieval, event analytics and evaluation operators as Spark DataFrame plans."""
