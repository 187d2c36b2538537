"""Collections of strings, and the files that transforms are kept in."""
