"""Column expressions: units, prices, text, deals, links, places and groups."""
