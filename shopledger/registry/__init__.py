"""Driver tables shaped as shop data, the registered queries and their SQL twins."""
