"""Table operators. Tables carry dataset_id, table_id and row_id next to their own columns."""
