"""Feature texts: parsing, macros, and the order in which features are computed."""
