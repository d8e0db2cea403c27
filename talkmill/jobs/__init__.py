"""talkmill jobs."""
