"""Part of talkweave, conversation-timeline analytics on Spark."""
