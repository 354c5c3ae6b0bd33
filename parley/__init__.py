"""Conversation-stream analytics on Spark: functions from DataFrame to DataFrame."""
