"""Part of terrane; see README.md."""
