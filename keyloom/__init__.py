"""Keyloom: keyspace analytics as set-at-a-time Spark operators."""
