"""What is decided while a plan is built: masks and row numbers."""
