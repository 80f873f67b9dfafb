"""The explicit batch view and its accessors."""
