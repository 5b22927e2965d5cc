"""Collections on disk, and readers and writers of other formats."""
