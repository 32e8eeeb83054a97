"""Column builders: everything here is an expression that Catalyst can plan."""
