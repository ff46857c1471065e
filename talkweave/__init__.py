"""talkweave: conversation-timeline analytics as DataFrame operators."""
