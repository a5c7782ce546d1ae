"""Function packs: each calls a family of built-in functions on a real column."""
