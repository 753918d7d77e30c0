"""Registered queries on the driver's tables, each with DuckDB SQL for the same rows where SQL has it."""
