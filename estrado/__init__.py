"""Spark jobs over the records of deliberative bodies: turns, fichas, vectors, alerts, text."""
