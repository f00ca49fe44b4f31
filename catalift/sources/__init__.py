"""Metadata sources, and table and file input and output."""

from catalift.sources.metadata import (
    catalog_inventory,
    column_inventory,
    database_inventory,
    describe_databases,
    describe_tables,
    list_catalogs,
    table_inventory,
)
from catalift.sources.inventory_csv import INVENTORY_SCHEMA, read_inventory, write_inventory
from catalift.sources.tables import (
    create_database,
    read_path,
    read_series,
    register_external,
    register_like,
    save_table,
    write_path,
)

__all__ = [
    "INVENTORY_SCHEMA",
    "catalog_inventory",
    "column_inventory",
    "create_database",
    "database_inventory",
    "describe_databases",
    "describe_tables",
    "list_catalogs",
    "read_inventory",
    "read_path",
    "read_series",
    "register_external",
    "register_like",
    "save_table",
    "table_inventory",
    "write_inventory",
    "write_path",
]
