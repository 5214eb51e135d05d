"""Parameters the registered queries and their SQL twins share."""

# Words that do occur in the driver texts.
KEYWORDS = (" the ", " heed", " par tre")
LIBRARY_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of",
    "on", "or", "that", "the", "this", "to", "was", "were", "which", "with",
)
