"""Schema facts and collection configuration; no data passes through here."""
