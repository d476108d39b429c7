"""Registered queries of the governance engine and the SQL that DuckDB checks them with."""
