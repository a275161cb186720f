"""Readers of measurement sources: cached payloads to rows.

A reader takes a table of payloads, (value string), a whole JSON or HTML text
in each, and gives (source_id, seq, model_name, vendor_hint, fields,
synthesized_from); ``fields`` maps names to texts.
"""
