"""Readers that turn raw inputs (JSON documents, encoded counters, frames) into typed rows."""
