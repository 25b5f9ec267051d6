"""Where inventories come from: listed trees, archives, and tables with content."""
