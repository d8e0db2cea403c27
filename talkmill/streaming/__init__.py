"""talkmill streaming."""
