"""Column functions: no DataFrame, no session, only expressions that stay in generated code."""
