"""Reading and writing the engine's tables, and views that adapt other tables to them."""
