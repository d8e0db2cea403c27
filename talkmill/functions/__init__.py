"""talkmill functions."""
