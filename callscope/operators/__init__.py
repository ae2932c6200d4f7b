"""DataFrame -> DataFrame operators, one module per inventory group."""
