"""Where runs are written: tables for many entities, TOML for reports of a few."""
