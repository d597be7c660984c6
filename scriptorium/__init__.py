"""Scriptorium: text, layout and corpus analytics as Spark DataFrame operators."""
