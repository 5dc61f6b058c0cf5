"""Readers and writers."""

from retail_insight.sources.files import first_existing, read_records, read_transactions_csv, read_transactions_parquet, with_row_numbers
from retail_insight.sources.sinks import export_folder, read_export, write_csv, write_parquet
from retail_insight.sources.tables import (
    orders_as_raw_transactions,
    events_as_raw_transactions,
    read_table,
)

__all__ = [
    "events_as_raw_transactions", "export_folder", "first_existing", "orders_as_raw_transactions",
    "read_export", "read_records", "read_table", "read_transactions_csv", "read_transactions_parquet",
    "with_row_numbers", "write_csv", "write_parquet",
]
