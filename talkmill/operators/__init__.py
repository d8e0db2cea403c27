"""talkmill operators."""
