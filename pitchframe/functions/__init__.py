"""Column-level helpers: null/tie/rounding rules, bins, pitch geometry."""
