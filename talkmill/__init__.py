"""talkmill: Spark jobs over large archives of exported chat conversations."""
