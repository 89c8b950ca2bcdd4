"""Prompt-set construction and evaluation analytics as Spark DataFrame operators."""
