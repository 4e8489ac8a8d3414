"""The gateway's operators: catalog listings, queries and DDL."""
