"""Operators for preparing training data; nothing else in talkmill imports this."""
