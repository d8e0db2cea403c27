"""talkmill sources."""
