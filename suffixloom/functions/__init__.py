"""Building blocks over ordered rows."""
