"""DataFrame -> DataFrame operators over the items table."""
