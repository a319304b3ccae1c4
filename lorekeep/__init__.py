"""Conversation-memory analytics on Spark: DataFrame operators for sessions, recall, graphs, topics, decay and profiles."""
