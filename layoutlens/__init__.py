"""Wrong-keyboard-layout repair analytics on Spark: lexicons, word and sentence decisions, keyed streams."""
