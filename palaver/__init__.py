"""Spark-first analytics over exported chats."""
