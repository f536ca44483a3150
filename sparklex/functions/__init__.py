"""Character tables and Column helpers."""
