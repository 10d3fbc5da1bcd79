"""Readers that turn raw log text into the normalized event schema."""
