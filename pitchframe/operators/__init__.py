"""DataFrame-level operators: first row per key, membership, top-k, shares, global lead, exact median."""
