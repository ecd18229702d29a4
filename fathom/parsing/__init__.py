"""Source files to definitions and captures."""
