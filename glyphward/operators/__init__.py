"""Rules, packs and the operators over findings."""
