"""Where logs come from: the driver's tables, stored logs and framed files."""
