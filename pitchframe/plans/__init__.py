"""The named analytics (passes, shots, standings, assists, match views) and their registry."""
