"""Readers with declared schemas, sinks, and the adapter from star-schema tables to panels."""
