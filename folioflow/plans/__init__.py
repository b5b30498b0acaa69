"""How plans are looked at."""
